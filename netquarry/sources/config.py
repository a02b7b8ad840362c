"""Partitioner configuration in XML, and weights made up for graphs that have none."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.operators.kernel import Options

#: Selection policies by element name (fixed values): of buckets with exclusive and with mixed resources.
POLICIES = {
    "single_resource_bucket": "single_resource", "use_random_resource_selection_policy": "random_resource", "use_largest_resource_imbalance_selection_policy": "largest_imbalance",
    "use_largest_unconstrained_gain_selection_policy": "largest_unconstrained_gain", "use_largest_gain_selection_policy": "largest_gain", "use_most_unbalanced_resource_selection_policy": "most_unbalanced",
    "use_best_gain_imbalance_score_classic_selection_policy": "best_gain_imbalance_classic", "use_best_gain_imbalance_score_with_affinities_selection_policy": "best_gain_imbalance_with_affinities",
}
PREPROCESSORS = {"all_universal_resource_strategy": "universal", "proportional_to_capacity_strategy": "proportional", "lowest_capacity_cost_strategy": "lowest_cost", "random_strategy": "random"}


@dataclass
class Config:
    capacity: list[int] = field(default_factory=list)
    ratio: list[int] = field(default_factory=list)
    share: list[float] = field(default_factory=list)
    preprocessor: str | None = None
    universal_resource: int = 0
    flexible_capacity: bool = False
    seed: int = 1
    supernode_cap: int = 0
    options: Options = Options()

    def validate(self) -> None:
        if not self.capacity:
            raise ValueError("no device resource")
        if any(c < 0 for c in self.capacity) or any(not 0 <= s <= 1 for s in self.share) or any(r <= 0 for r in self.ratio):
            raise ValueError("capacities can't be negative, ratio weights are positive, imbalances are between 0 and 1")
        if self.preprocessor == "universal" and not 0 <= self.universal_resource < len(self.capacity):
            raise ValueError("the universal resource is no resource of the device")


#: Elements that hold others or carry no option of their own, by name (fixed values).
FRAME = (
    "partitioner_configuration", "general_configuration", "preprocessor_configuration", "klfm_configuration", "postprocessor_configuration", "device_resource", "resource_id", "resource_capacity", "resource_ratio_weight", "max_imbalance",
    "gain_bucket_type", "multi_resource_exclusive_bucket", "multi_resource_mixed_bucket", "node_implementation_options", "mutation_options", "rebalance_options", "use_total_capacity")
#: Elements that are options (fixed values), besides POLICIES and PREPROCESSORS.
FLAGS = {
    "use_flexible_capacity": None, "use_multilevel_constraint_relaxation": "relax_coarse", "use_adaptive_implementations": "adaptive", "use_ratio_as_quality_metric": "ratio_as_quality", "use_ratio_in_score": "ratio_in_score",
    "reuse_previous_run_implementations": "reuse_implementations", "rebalance_on_start_of_pass": "rebalance", "rebalance_on_end_of_run": "rebalance_at_end", "rebalance_on_demand": "rebalance_on_demand",
    "restrict_supernodes_to_default_implementation": None}
NUMBERS = {
    "fixed_random_seed": "seed", "mutation_rate": "mutation_rate", "rebalance_on_demand_cap_per_run": "demand_per_run", "rebalance_on_demand_cap_per_pass": "demand_per_pass", "universal_resource_id": None, "supernode_implementations_cap": None}


def read_config(text: str) -> Config:
    """A configuration's XML; a resource without a ratio weight has 1. Elements that are no part of the grammar raise."""
    root = ET.fromstring(text)
    tags = {e.tag: e for e in root.iter() if isinstance(e.tag, str)}
    if unknown := sorted(t for t in tags if t not in (*FRAME, *FLAGS, *NUMBERS, *POLICIES, *PREPROCESSORS)):
        raise ValueError(f"unknown elements in the configuration: {', '.join(unknown)}")
    resources = sorted(root.iter("device_resource"), key=lambda r: int(r.findtext("resource_id", "0")))
    c = Config(
        [int(r.findtext("resource_capacity", "0")) for r in resources], [int(r.findtext("resource_ratio_weight") or 1) for r in resources], [float(r.findtext("max_imbalance", "1")) for r in resources])
    number = lambda tag, default=0: int(tags[tag].text or default) if tag in tags else default
    for tag, name in PREPROCESSORS.items():
        if tag in tags:
            c.preprocessor = name
    c.universal_resource, c.flexible_capacity, c.seed = number("universal_resource_id"), "use_flexible_capacity" in tags, number("fixed_random_seed", 1)
    c.supernode_cap = 1 if "restrict_supernodes_to_default_implementation" in tags else number("supernode_implementations_cap")
    policy = next((p for tag, p in POLICIES.items() if tag in tags), Options.policy)
    share = [c.share[0], *[0.99] * (len(c.share) - 1)] if policy == "single_resource" else c.share
    flags = {option: tag in tags for tag, option in FLAGS.items() if option}
    numbers = {option: number(tag) for tag, option in NUMBERS.items() if option and option != "seed"}
    c.options = Options(share=tuple(share), ratio=tuple(c.ratio), policy=policy, seed=c.seed, supernode_cap=c.supernode_cap, **flags, **numbers)
    c.validate()
    return c


def resources(spark: SparkSession, c: Config) -> DataFrame:
    """(res_id, capacity, ratio_weight, max_imbalance)"""
    return spark.createDataFrame([(i, *x) for i, x in enumerate(zip(c.capacity, c.ratio, c.share))], "res_id int, capacity long, ratio_weight int, max_imbalance double")


def synthetic_weights(nodes: DataFrame, kinds: list[tuple[float, int, int]], seed: int = 1, binomial: bool = False, cluster: int = 1) -> DataFrame:
    """(node_id, impls): each node is of one resource, by the kinds' shares, with a weight between their bounds.

    kinds: (share, least, most) by resource. Weights are uniform, or binomial with a chance of one half. So many
    neighbouring nodes as a cluster has are of one kind. Draws are hashes of seed and node, so that they don't hang on
    partitions.
    """
    u = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.floor(F.col("node_id") / cluster) if k == 0 else F.col("node_id")), F.lit(1 << 30)) / (1 << 30)
    kind, total = F.lit(len(kinds) - 1), 0.0
    cuts = []
    for i, (share, _, _) in enumerate(kinds[:-1]):
        total += share
        cuts.append((total, i))
    for bound, i in reversed(cuts):
        kind = F.when(u(0) < bound, i).otherwise(kind)
    least, most = (F.get(F.array(*[F.lit(k[j]) for k in kinds]), kind) for j in (1, 2))
    if binomial:
        words = F.sequence(F.lit(0), F.floor((most - least) / 64).cast("int"))
        # a hash has 64 fair bits; of the last one as many count as are left
        used = lambda i: F.xxhash64(F.lit(seed), F.lit(2), "node_id", i)
        left = lambda i: F.least(F.lit(64), most - least - 64 * i)
        ones = lambda i: F.when(left(i) >= 64, F.bit_count(used(i))).otherwise(F.bit_count(used(i).bitwiseAND(F.pow(F.lit(2.0), left(i)).cast("long") - 1)))
        weight = (least + F.aggregate(words, F.lit(0), lambda n, i: n + ones(i))).cast("int")
    else:
        weight = (least + F.floor(u(1) * (most - least + 1))).cast("int")
    vector = F.array(*[F.when(kind == i, weight).otherwise(0) for i in range(len(kinds))])
    return nodes.select("node_id", F.array(vector).alias("impls"))
