"""Token counts by heap-and-linked-list byte-pair merging.

A word's count is its initial symbols less the merges that apply; no token identifiers are made. Words recur, so each
worker remembers counts of words, up to a bound.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.llm.common import bounded_batches, only_memo, slices, strings

#: Words that a worker remembers, as they stand in texts and as the pattern cuts them; at this many it starts anew.
MEMO_WORDS = 500_000
_models: dict[bytes, "WordBpe"] = {}


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 stands for itself; every other byte takes the next code point from 256 on.
    """
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class WordBpe(dict):
    """word -> number of tokens, computed when first asked for; made from a tokenizer's JSON."""

    def __init__(self, blob: bytes):
        spec = json.loads(blob)
        self.blob, self.newer = blob, None
        model = spec["model"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or not split["invert"] or model["unk_token"]:
            raise ValueError("only byte-level word BPE with NFC, white space and lower-case normalisers is known")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.special = regex.compile("|".join(regex.escape(x["content"]) for x in sorted(spec["added_tokens"], key=lambda x: -len(x["content"]))))
        self.has_special = bool(spec["added_tokens"])
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab = frozenset(model["vocab"])
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): r for r, m in enumerate(model["merges"])}
        self.alphabet = byte_alphabet()
        self.written = Memo(self.count_word)

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        symbols = [self.alphabet[b] for b in word.encode()]
        symbols[-1] += self.suffix
        if not self.vocab.issuperset(symbols):
            symbols = [s for s in symbols if s in self.vocab]
        n = len(symbols) - merges(symbols, self.ranks)
        if len(word) < 100:
            self[word] = n
        return n

    def count_word(self, word: str) -> int:
        """The tokens of a stretch of text that white space ends."""
        if self.has_special and len(parts := self.special.split(word)) > 1:
            return len(parts) - 1 + sum(self.count_word(p) for p in parts if p)
        if not word.isascii() and any(unicodedata.category(c) == "Cn" for c in word):
            return sum(map(self.__getitem__, self.newer_words(word)))
        # White space never gets into a token, so that it is not made uniform first. Lower case goes character by
        # character: a final capital sigma is no special case.
        return sum(map(self.__getitem__, self.pattern.findall(unicodedata.normalize("NFC", word).replace("Σ", "σ").lower())))

    def newer_words(self, word: str) -> list[str]:
        """Cuts text with code points that are newer than Python's Unicode tables, by the tables of the library itself."""
        import tokenizers

        if self.newer is None:
            split = tokenizers.pre_tokenizers.Split(tokenizers.Regex(self.pattern.pattern), "removed", invert=True)
            self.newer = tokenizers.Tokenizer.from_str(self.blob.decode()).normalizer, split
        normal, split = self.newer
        return [x for x, _ in split.pre_tokenize_str(normal.normalize_str(word))]

    def count(self, text: str) -> int:
        return sum(map(self.written.__getitem__, text.replace("\n", " ").split(" ")))


class Memo(dict):
    def __init__(self, f: Callable[[str], int]):
        self.f = f

    def __missing__(self, key: str) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        n = self.f(key)
        if len(key) < 100:
            self[key] = n
        return n


def merges(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many merges apply when the adjacent pair of lowest rank, leftmost first, is merged again and again."""
    n = len(symbols)
    after, before = [*range(1, n), -1], list(range(-1, n - 1))
    heap = [(r, i, pair) for i, pair in enumerate(zip(symbols, symbols[1:])) if (r := ranks.get(pair)) is not None]
    heapq.heapify(heap)
    at: list[str | None] = list(symbols)
    done = 0
    while heap:
        _, i, (left, right) = heapq.heappop(heap)
        j = after[i]
        if at[i] != left or j < 0 or at[j] != right:
            continue  # one of the two has been merged since
        at[i], at[j], done = left + right, None, done + 1
        after[i] = k = after[j]
        after[j] = -1
        if k >= 0:
            before[k] = i
            if (r := ranks.get(pair := (at[i], at[k]))) is not None:
                heapq.heappush(heap, (r, i, pair))
        if (h := before[i]) >= 0 and (r := ranks.get(pair := (at[h], at[i]))) is not None:
            heapq.heappush(heap, (r, h, pair))
    return done


def model(blob: bytes) -> WordBpe:
    """One model per worker process and vocabulary."""
    key = hashlib.sha256(blob).digest()
    only_memo("token counts", _models.clear)
    if key not in _models:
        _models[key] = WordBpe(blob)
    return _models[key]


def count_tokens(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row, in one narrow pass.

    vocabulary is the path of a tokenizer's JSON on the driver; its content (fixed in size) is broadcast. A null text counts
    as empty: 0 bytes, 0 tokens. Texts are neither truncated nor padded. Rows are independent: repeated rows and null ids
    come out as they came in; an empty table gives an empty table; other columns of df are not read.
    """
    with open(vocabulary, "rb") as f:
        blob = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(blob.value)
        for part in slices(batches):
            counts = [bpe.count(x) for x in strings(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("n_bytes"), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    bounded_batches(df)
    source = df.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long").select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
