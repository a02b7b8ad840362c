"""A reader of whole value change dumps, token by token: what the reader in splits is held against."""

import re

TRACKED = ("supply0", "supply1", "tri", "triand", "trior", "trireg", "tri0", "tri1", "wand", "wire", "wor", "reg")
SIMULATION = ("$dumpall", "$dumpoff", "$dumpon", "$dumpvars")
_var = re.compile(r"(\w+)\s+(\d+)\s+(\S+)\s+(\\\S+|[^\s\[]+)\s*(?:\[\s*(-?\d+)\s*(?::\s*(-?\d+)\s*)?\])?")


def commands(text):
    """(seq, kind, t, word, value) of a dump; seq is the number of a command's first token."""
    tokens, t, n, out = text.split(), 0, 0, []
    while n < len(tokens):
        token = tokens[n]
        if token in SIMULATION:
            out.append((n, "simulation", t, token, None))
        elif token[0] == "$" and token != "$end":
            end = tokens.index("$end", n) if "$end" in tokens[n:] else len(tokens)
            out.append((n, "declaration", t, token, " ".join(tokens[n + 1:end])))
            n = end
        elif token[0] == "#" and token[1:].isdigit():
            t = int(token[1:])
            out.append((n, "time", t, None, None))
        elif token[0] in "bBrR":
            if n + 1 < len(tokens):
                out.append((n, "change", t, tokens[n + 1], token))
            n += 1
        elif token[0] in "01xXzZ" and len(token) > 1:
            out.append((n, "change", t, token[1:], token[0]))
        elif token != "$end":
            out.append((n, "unknown", t, token, None))
        n += 1
    return out


def extend(value, width):
    """A vector's value at full width, lowest bit first."""
    value = value.lower()
    return value[::-1][:width].ljust(width, value[0] if value[:1] in ("x", "z") else "0")


def changes(text):
    """(signal, bit, t, seq, v)."""
    known, scopes, out = {}, [], []
    for seq, kind, t, word, value in commands(text):
        if kind == "declaration":
            if word == "$scope":
                scopes.append(value.split()[-1])
            elif word == "$upscope":
                scopes.pop()
            elif word == "$var" and (v := _var.match(value)) and v[1] in TRACKED:
                bounds = [int(x) for x in v.groups()[4:] if x is not None]
                known.setdefault(v[3], ("/".join([*scopes[2:], v[4]]), int(v[2]), min(bounds, default=0)))
    for seq, kind, t, word, value in commands(text):
        if kind == "change" and word in known and value[0] not in "rR":
            name, width, low = known[word]
            out += [(name, low + i, t, seq, v) for i, v in enumerate(extend(value.lstrip("bB"), width))]
    return out
