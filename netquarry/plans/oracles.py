"""DuckDB SQL with the results of the registered queries, written from their definitions and not from their plans."""

from __future__ import annotations

_base = {
    "raw": "SELECT l_orderkey AS edge_id, l_partkey AS node_id FROM lineitem",
    "all_pins": "SELECT DISTINCT edge_id, node_id FROM raw",
    "pins": "SELECT * FROM all_pins WHERE edge_id IN (SELECT edge_id FROM all_pins GROUP BY 1 HAVING count(*) >= 2)",
    "edges": "SELECT o_orderkey AS edge_id, 1.0::DOUBLE AS width, (o_orderkey % 100) / 100.0 AS entropy FROM orders",
    "sides": "SELECT edge_id, count(*) FILTER (node_id % 2 = 0)::BIGINT AS cnt_a, count(*) FILTER (node_id % 2 = 1)::BIGINT AS cnt_b FROM pins GROUP BY 1",
    "cut": "SELECT sides.*, cnt_a > 0 AND cnt_b > 0 AS crosses, width, entropy FROM sides JOIN edges USING (edge_id)",
    "options": """SELECT p_partkey AS node_id, x.i AS kind, x.v AS v, (row_number() OVER (PARTITION BY p_partkey ORDER BY x.i) - 1)::INT AS idx, (count(*) OVER (PARTITION BY p_partkey))::INT AS n
        FROM (SELECT p_partkey, unnest([{'i': 0, 'v': [p_size, 0, 0], 'ok': true}, {'i': 1, 'v': [0, p_size * 2, 0], 'ok': p_partkey % 3 = 0}, {'i': 2, 'v': [0, 0, p_size * 3], 'ok': p_partkey % 5 = 0}]) AS x FROM part) WHERE x.ok""",
    "chosen": "SELECT node_id, v, idx, n, (node_id % 2)::INT AS part FROM options WHERE idx = node_id % n",
    "resources": """SELECT r::INT AS res_id, coalesce(sum(v[r + 1]) FILTER (part = 0), 0)::BIGINT AS w_a, coalesce(sum(v[r + 1]) FILTER (part = 1), 0)::BIGINT AS w_b,
        (coalesce(sum(v[r + 1]) FILTER (part = 0), 0) - coalesce(sum(v[r + 1]) FILTER (part = 1), 0))::BIGINT AS balance, sum(v[r + 1])::BIGINT AS total FROM chosen, range(3) t(r) GROUP BY 1""",
    "allowed": "SELECT *, greatest(1, floor(total * 0.05))::BIGINT AS m, [200, 74, 105][res_id + 1] AS ratio, abs(balance / greatest(1, floor(total * 0.05))) AS rel FROM resources",
    "gained": """SELECT node_id, (node_id % 2)::INT AS part, sum(CASE WHEN own = 1 THEN width WHEN other = 0 THEN -width ELSE 0 END)::DOUBLE AS gain
        FROM (SELECT node_id, CASE WHEN node_id % 2 = 0 THEN cnt_a ELSE cnt_b END AS own, CASE WHEN node_id % 2 = 0 THEN cnt_b ELSE cnt_a END AS other, width FROM pins JOIN cut USING (edge_id)) GROUP BY 1""",
    "runs": """SELECT run_id, count(*) FILTER (a <> b)::DOUBLE AS cost FROM (
        SELECT r::INT AS run_id, edge_id, min(((node_id * 1103515245 + 12345 + r * 7919) % 2147483648) // 65536 % 2) AS a, max(((node_id * 1103515245 + 12345 + r * 7919) % 2147483648) // 65536 % 2) AS b
        FROM pins, range(32) t(r) GROUP BY 1, 2) GROUP BY 1""",
    "changes": "SELECT user_id::VARCHAR AS signal, epoch_us(ts) - 1704067200000000 AS t, event_id AS seq, event_type, value FROM events",
    "trace_end": "SELECT max(t) AS t_end FROM changes",
    "vdd": "SELECT signal, t, seq, CASE WHEN event_type = 'error' THEN 'x' WHEN value > @T@ THEN '1' ELSE '0' END AS v FROM changes UNION ALL SELECT DISTINCT signal, 0, -1, 'x' FROM changes",
    "held": "SELECT signal, v, t AS t0, coalesce(lead(t) OVER (PARTITION BY signal ORDER BY t, seq), (SELECT t_end FROM trace_end)) AS t1 FROM vdd",
    "dwell": """SELECT signal, 0 AS bit, coalesce(sum(t1 - t0) FILTER (v = '0'), 0)::BIGINT AS n0, coalesce(sum(t1 - t0) FILTER (v = '1'), 0)::BIGINT AS n1,
        coalesce(sum(t1 - t0) FILTER (v = 'x'), 0)::BIGINT AS nx, coalesce(sum(t1 - t0) FILTER (v = 'z'), 0)::BIGINT AS nz FROM held WHERE t1 > t0 GROUP BY 1""",
    "cut_held": """SELECT signal, v, slice, greatest(t0, slice * 86400000000) AS t0, least(t1, (slice + 1) * 86400000000) AS t1
        FROM (SELECT *, unnest(range(t0 // 86400000000, (t1 - 1) // 86400000000 + 1)) AS slice FROM held WHERE t1 > t0)""",
    "sliced": """SELECT signal, 0 AS bit, slice, coalesce(sum(t1 - t0) FILTER (v = '0'), 0)::BIGINT AS n0, coalesce(sum(t1 - t0) FILTER (v = '1'), 0)::BIGINT AS n1,
        coalesce(sum(t1 - t0) FILTER (v = 'x'), 0)::BIGINT AS nx, coalesce(sum(t1 - t0) FILTER (v = 'z'), 0)::BIGINT AS nz FROM cut_held GROUP BY 1, 3""",
}


def h(p: str) -> str:
    return f"(CASE WHEN ({p}) <= 0 OR ({p}) >= 1 THEN 0.0 ELSE least(1.0, greatest(0.0, -({p}) * log2({p}) - (1 - ({p})) * log2(1 - ({p})))) END)"


_p = "(CASE WHEN n0 + n1 + nx + nz = 0 THEN 0.0 ELSE (CASE WHEN n1 > n0 THEN n1 + nx + nz ELSE n1 END) / (n0 + n1 + nx + nz) END)"
_biased = "(CASE WHEN n0 + n1 + nx + nz = 0 THEN 0.0 ELSE (CASE WHEN n1 > 1.1 * n0 THEN n1 + nx + nz ELSE n1 END) / (n0 + n1 + nx + nz) END)"
_base["gold"] = f"SELECT signal, round({h(_p)}, 9) AS h FROM dwell"
_base["other"] = f"SELECT signal, round({h(_p)}, 9) AS h FROM dwell2 WHERE signal::BIGINT % 5 <> 0"
for _n, _f in (("vdd2", "vdd"), ("held2", "held"), ("dwell2", "dwell")):
    _base[_n] = _base[_f].replace("FROM vdd", "FROM vdd2").replace("FROM held", "FROM held2").replace("@T@", "150")
_base["vdd"] = _base["vdd"].replace("@T@", "100")
_order = ["raw", "all_pins", "pins", "edges", "sides", "cut", "options", "chosen", "resources", "allowed", "gained", "runs", "changes", "trace_end", "vdd", "held", "dwell", "cut_held", "sliced", "vdd2", "held2", "dwell2", "gold", "other"]


def sql(body: str, **more: str) -> str:
    """The body after the tables that it, or a table it uses, names."""
    import re

    used: set[str] = set()
    todo = [body, *more.values()]
    while todo:
        text = todo.pop()
        for n in _order:
            if n not in used and re.search(rf"\b(FROM|JOIN)\s+{n}\b|,\s*{n}\b", text):
                used.add(n)
                todo.append(_base[n])
    tables = [f"{n} AS ({_base[n]})" for n in _order if n in used] + [f"{n} AS ({t})" for n, t in more.items()]
    return (f"WITH RECURSIVE {', '.join(tables)} " if tables else "") + body


_k = "p_partkey"
_ps = ["((p_partkey * 37) % 101) / 100.0", "((p_partkey * 53) % 101) / 100.0", "((p_partkey * 71) % 101) / 100.0"]
_mux = f"(({_ps[0]}) * ({_ps[2]}) + (1 - ({_ps[0]})) * ({_ps[1]}))"
_lut2 = lambda a, b, init: f"((({init}) & 1) * (1 - ({a})) * (1 - ({b})) + ((({init}) >> 1) & 1) * ({a}) * (1 - ({b})) + ((({init}) >> 2) & 1) * (1 - ({a})) * ({b}) + ((({init}) >> 3) & 1) * ({a}) * ({b}))"
_name32 = "(SELECT string_agg(substr('0123456789abcdefghijklmnopqrstuv', ((@ >> (5 * i)) & 31)::INT + 1, 1), '' ORDER BY i) FROM range(12) t(i) WHERE i = 0 OR (@ >> (5 * i)) > 0)"
_vname = lambda c: _name32.replace("@", c)
_power = lambda b: f"(SELECT sum(pow(CASE WHEN r > 0.8 THEN r * 16 ELSE r END, 2)) FROM (SELECT abs(({b}) / m::DOUBLE) AS r FROM allowed))"
_parity = "SELECT p_partkey AS node_id, (p_partkey % 2)::INT AS part FROM part"
_escape = lambda s: f"(CASE WHEN starts_with({s}, '\\') THEN {s} WHEN regexp_matches({s}, '\\[[^\\[]*\\]$') THEN '\\' || regexp_replace({s}, '^(.*)(\\[[^\\[]*\\])$', '\\1 \\2') ELSE '\\' || {s} || ' ' END)"

_moves = {
    "moves": "SELECT node_id, part, 2 * (row_number() OVER (PARTITION BY part ORDER BY gain DESC, node_id) - 1) + part AS place FROM gained WHERE gain >= 0",
    # a net's pins on the first side before each of its moving pins
    "moving": "SELECT place, moves.node_id, part, width, cnt_a + cnt_b AS n, cnt_a + coalesce(sum(CASE WHEN part = 0 THEN -1 ELSE 1 END) OVER (PARTITION BY edge_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM pins JOIN moves USING (node_id) JOIN cut USING (edge_id)",
    "effects": "SELECT node_id, place, sum(width * ((CASE WHEN part = 0 THEN a - 1 ELSE a + 1 END BETWEEN 1 AND n - 1)::INT - (a BETWEEN 1 AND n - 1)::INT)) AS change FROM moving GROUP BY 1, 2",
}
_forest = {
    "parents": "SELECT p_partkey AS node_id, -(p_partkey // 4 + 1) AS super_id FROM part UNION SELECT -(p_partkey // 4 + 1), -(p_partkey // 16 + 1000000001) FROM part UNION SELECT -(p_partkey // 16 + 1000000001), -(p_partkey // 64 + 2000000001) FROM part",
    "up": "SELECT node_id, super_id AS top, 1 AS height FROM parents UNION ALL SELECT up.node_id, parents.super_id, height + 1 FROM up JOIN parents ON parents.node_id = top",
}

SQL: dict[str, str] = {
    "hg_pins": sql("SELECT * FROM pins"),
    "hg_degree_hist": sql("SELECT degree, count(*)::BIGINT AS n_edges FROM (SELECT edge_id, count(*)::BIGINT AS degree FROM pins GROUP BY 1) GROUP BY 1"),
    "hg_cut_cost": sql("SELECT count(*)::BIGINT AS n_edges, count(*) FILTER (crosses)::BIGINT AS n_cut, coalesce(sum(width) FILTER (crosses), 0)::DOUBLE AS cut_cost, coalesce(sum(width::INT) FILTER (crosses), 0)::BIGINT AS cut_span, round(coalesce(sum(entropy) FILTER (crosses), 0), 6)::DOUBLE AS cut_entropy FROM cut"),
    "hg_cut_entropy": sql("SELECT count(*) FILTER (crosses)::BIGINT AS n_cut, round(coalesce(sum(entropy) FILTER (crosses), 0), 6)::DOUBLE AS cut_cost FROM cut"),
    "hg_cut_edges": sql("SELECT edge_id, cnt_a, cnt_b FROM sides WHERE cnt_a > 0 AND cnt_b > 0"),
    "hg_critical_edges": sql("SELECT edge_id, cnt_a <= 2 OR cnt_b <= 2 AS critical, cnt_a > 0 AND cnt_b > 0 AS crosses FROM sides"),
    "hg_balance": sql("SELECT * FROM resources"),
    "hg_resource_report": sql("""SELECT res_id, total, m AS max_imbalance, round(CASE WHEN total = 0 THEN 0.0 ELSE abs(balance) / total END, 9)::DOUBLE AS imbalance, round(total / sum(total) OVER (), 9)::DOUBLE AS graph_ratio,
        round(w_a / sum(w_a) OVER (), 9)::DOUBLE AS ratio_a, round(w_b / sum(w_b) OVER (), 9)::DOUBLE AS ratio_b, abs(balance) > m AS violated FROM allowed"""),
    "hg_max_imbalance": sql("SELECT res_id, m AS max_imbalance FROM allowed"),
    "hg_imbalance_power": sql("SELECT round(sum(pow(CASE WHEN rel > 0.8 THEN rel * 16 ELSE rel END, 2)), 6) AS imbalance_power, round(sum(CASE WHEN rel > 0.8 THEN rel * rel ELSE 0 END), 6) AS near_power, round(sum(CASE WHEN rel > 1 THEN rel * rel ELSE 0 END), 6) AS violator_power, bool_or(abs(balance) > m) AS violated FROM allowed"),
    "hg_ratio_power": sql("SELECT round(sum(pow(abs(total - ratio * s) / (ratio * s), 2)) / 10, 9) AS ratio_power FROM (SELECT *, (sum(total) OVER ())::DOUBLE / sum(ratio) OVER () AS s FROM allowed)"),
    "hg_ratio_power_if_changed": sql("""SELECT node_id, round(sum(pow(abs(t - ratio * s) / (ratio * s), 2)) / 10, 9) AS ratio_power FROM (
        SELECT c.node_id, ratio, total + o.v[res_id + 1] - c.v[res_id + 1] AS t, (sum(total + o.v[res_id + 1] - c.v[res_id + 1]) OVER (PARTITION BY c.node_id))::DOUBLE / (sum(ratio) OVER (PARTITION BY c.node_id)) AS s
        FROM chosen c JOIN options o ON o.node_id = c.node_id AND o.idx = (c.idx + 1) % c.n AND c.n > 1, allowed) GROUP BY 1"""),
    "hg_rms_deviation": sql("""SELECT round(a, 9) AS rms_a, round(b, 9) AS rms_b, round((a + b) / 2, 9) AS rms_avg FROM (SELECT
        sqrt(avg(CASE WHEN w_a = 0 THEN 0 ELSE pow(abs(sa * (ratio / 379.0::DOUBLE) - w_a) / w_a, 2) END)) AS a, sqrt(avg(CASE WHEN w_b = 0 THEN 0 ELSE pow(abs(sb * (ratio / 379.0::DOUBLE) - w_b) / w_b, 2) END)) AS b
        FROM (SELECT *, sum(w_a) OVER () AS sa, sum(w_b) OVER () AS sb FROM allowed))"""),
    "hg_initial_gains": sql("SELECT * FROM gained"),
    "hg_move_scores": sql(f"""SELECT node_id, round(p, 6) AS power_if_moved, round(p - gain, 6) AS score FROM (
        SELECT g.node_id, g.gain, {_power("balance + (CASE WHEN g.part = 0 THEN -2 ELSE 2 END) * c.v[res_id + 1]")} AS p FROM gained g JOIN chosen c USING (node_id))"""),
    "hg_adaptive_impl": sql(f"""SELECT node_id, arg_min(idx, (round(p, 9), idx))::INT AS impl FROM (
        SELECT o.node_id, o.idx, {_power("balance + (CASE WHEN o.node_id % 2 = 0 THEN -2 ELSE 2 END) * o.v[res_id + 1]")} AS p FROM options o WHERE o.n > 1) GROUP BY 1"""),
    "hg_affinity": sql("SELECT node_id, (list_position(x, list_max(x)) - 1)::INT AS res_id FROM (SELECT node_id, [v[1] / 2000000.0, v[2] / 740741.0, v[3] / 1052632.0] AS x FROM chosen)"),
    "hg_topk_gain": sql("""SELECT part, res_id, node_id, gain, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY part, res_id ORDER BY gain DESC, node_id) AS rank FROM (
        SELECT g.part, g.node_id, gain, (list_position(x, list_max(x)) - 1)::INT AS res_id FROM gained g JOIN (SELECT node_id, [v[1] / 2000000.0, v[2] / 740741.0, v[3] / 1052632.0] AS x FROM chosen) USING (node_id))) WHERE rank <= 3"""),
    "hg_best_prefix": sql("""SELECT run_id, CASE WHEN b.cost < 1000 THEN b.step ELSE 0 END AS best_step, CASE WHEN b.cost < 1000 THEN b.cost ELSE 1000.0 END::DOUBLE AS best_cost FROM (
        SELECT run_id, min({'cost': cost, 'step': step}) AS b FROM (SELECT node_id % 16 AS run_id, node_id AS step, round(1000 - sum(gain) OVER (PARTITION BY node_id % 16 ORDER BY node_id), 6) AS cost FROM gained) GROUP BY 1)"""),
    "hg_universal_impl": sql("SELECT node_id, arg_min(idx, (-v[3], idx))::INT AS sel FROM options GROUP BY 1"),
    "hg_lowest_cost_impl": sql("SELECT node_id, arg_min(idx, (greatest(v[1] / 2000000.0::DOUBLE, v[2] / 740741.0::DOUBLE, v[3] / 1052632.0::DOUBLE), idx))::INT AS sel FROM options GROUP BY 1"),
    "hg_random_impl": sql("SELECT node_id, (((node_id * 1103515245 + 12352) % 2147483648) // 65536 % n)::INT AS sel FROM options WHERE idx = 0"),
    "hg_mutation": sql("SELECT node_id, CASE WHEN ((node_id * 1103515245 + 12352) % 2147483648) // 65536 % 100 < 30 THEN ((node_id * 1103515245 + 12353) % 2147483648) // 65536 % n ELSE node_id % n END::INT AS sel FROM options WHERE idx = 0"),
    "hg_flexible_capacity": sql("SELECT r::INT AS res_id, ([2000000, 740741, 1052632][r + 1] - coalesce((SELECT sum(v[r + 1]) FROM options WHERE n = 1), 0))::BIGINT AS capacity FROM range(3) t(r)"),
    "hg_capacity_percent": sql("SELECT res_id, (total * 100 // [2000000, 740741, 1052632][res_id + 1])::INT AS percent FROM resources"),
    "hg_fanout_prune": sql("SELECT edge_id, degree FROM (SELECT o_custkey AS edge_id, count(DISTINCT l_partkey)::BIGINT AS degree FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) WHERE degree > 40"),
    "hg_dangling_ports": sql("SELECT edge_id, min(node_id) AS node_id FROM all_pins GROUP BY 1 HAVING count(*) < 2"),
    "hg_strip_ports": sql("SELECT * FROM kept WHERE edge_id IN (SELECT edge_id FROM kept GROUP BY 1 HAVING count(*) >= 2)", kept="SELECT * FROM all_pins WHERE node_id % 10 <> 0"),
    "hg_neighbors": sql("SELECT a.node_id, count(DISTINCT b.node_id)::BIGINT AS n_neighbors FROM small a JOIN small b ON a.edge_id = b.edge_id AND a.node_id <> b.node_id GROUP BY 1", small="SELECT * FROM pins WHERE edge_id IN (SELECT edge_id FROM pins GROUP BY 1 HAVING count(*) < 50)"),
    "hg_contract": sql("SELECT edge_id, count(*)::BIGINT AS degree, sum(super_id)::BIGINT AS super_sum FROM (SELECT DISTINCT edge_id, node_id // 4 AS super_id FROM pins) GROUP BY 1 HAVING count(*) >= 2"),
    "hg_coarse_cut": sql("SELECT n AS coarse_cut, n AS fine_cut FROM (SELECT count(*)::BIGINT AS n FROM (SELECT edge_id FROM pins GROUP BY 1 HAVING min(node_id // 4 % 2) <> max(node_id // 4 % 2)))"),
    "hg_expand_balance": sql("""SELECT r::INT AS res_id, coalesce(sum(v[r + 1]) FILTER (node_id // 4 % 2 = 0), 0)::BIGINT AS w_a, coalesce(sum(v[r + 1]) FILTER (node_id // 4 % 2 = 1), 0)::BIGINT AS w_b,
        (coalesce(sum(v[r + 1]) FILTER (node_id // 4 % 2 = 0), 0) - coalesce(sum(v[r + 1]) FILTER (node_id // 4 % 2 = 1), 0))::BIGINT AS balance, sum(v[r + 1])::BIGINT AS total FROM chosen, range(3) t(r) GROUP BY 1"""),
    "hg_boundary_edges": sql("SELECT edge_id, bool_and(node_id % 3 <> 1) AS internal FROM pins GROUP BY 1 HAVING bool_or(node_id % 3 <> 1)"),
    "hg_kway_internal_edges": sql("SELECT edge_id, min(node_id % 4)::INT AS part FROM pins GROUP BY 1 HAVING count(DISTINCT node_id % 4) = 1"),
    "hg_swap_identity": "SELECT true AS identical",
    "hg_run_costs": sql("SELECT run_id, cost FROM runs"),
    "hg_run_stats": sql("SELECT count(*)::BIGINT AS n, min(cost) AS min, max(cost) AS max, round(avg(cost), 9) AS avg, list_sort(list(cost))[count(*) // 2 + 1] AS median, round(stddev_pop(cost), 9) AS sigma FROM runs"),
    "hg_supernodes": "SELECT (p_partkey // 4)::BIGINT AS super_id FROM part GROUP BY 1 HAVING count(*) > 1",
    "hg_run_listing": sql("SELECT row_number() OVER (ORDER BY cost, run_id)::INT AS place, run_id, cost FROM runs"),
    "hg_run_cumulative": sql("""SELECT b::INT AS bucket, (lo + b * width)::BIGINT AS low, (lo + (b + 1) * width)::BIGINT AS high, (SELECT count(*) FROM runs WHERE least(buckets - 1, floor((cost - lo) / width)) <= b)::BIGINT AS n
        FROM (SELECT *, floor((hi - lo) / buckets + 1)::BIGINT AS width FROM (SELECT min(cost)::BIGINT AS lo, max(cost)::BIGINT AS hi, CASE WHEN (max(cost) - min(cost)) / 10 > 10 THEN 10 WHEN (max(cost) - min(cost)) / 5 > 10 THEN 5 ELSE 1 END AS buckets FROM runs)) s, range(10) t(b) WHERE b < buckets"""),
    "hg_run_histogram": sql("""SELECT b::INT AS bucket, (lo + b * width)::BIGINT AS low, (lo + (b + 1) * width)::BIGINT AS high, (SELECT count(*) FROM runs WHERE least(buckets - 1, floor((cost - lo) / width)) = b)::BIGINT AS n
        FROM (SELECT *, floor((hi - lo) / buckets + 1)::BIGINT AS width FROM (SELECT min(cost)::BIGINT AS lo, max(cost)::BIGINT AS hi, CASE WHEN (max(cost) - min(cost)) / 10 > 10 THEN 10 WHEN (max(cost) - min(cost)) / 5 > 10 THEN 5 ELSE 1 END AS buckets FROM runs)) s, range(10) t(b) WHERE b < buckets"""),
    "hg_kway_min_cost": sql("""SELECT level, b.run_id AS best_run, b.total AS cumulative_cost FROM (SELECT level, min({'total': total, 'run_id': run}) AS b FROM (
        SELECT (run_id // 8)::INT AS level, run_id % 8 AS run, round(sum(cost) OVER (PARTITION BY run_id % 8 ORDER BY run_id // 8), 6) AS total FROM runs) GROUP BY 1)"""),
    "hg_cut_union": sql("SELECT DISTINCT 'net' || (edge_id // 2) AS name FROM (SELECT edge_id FROM pins GROUP BY 1 HAVING min(node_id % 2) <> max(node_id % 2) UNION SELECT edge_id FROM pins GROUP BY 1 HAVING bool_or(node_id % 7 < 3) AND NOT bool_and(node_id % 7 < 3))"),
    "hg_supernode_impls": sql(
        "SELECT s AS super_id, n_impls, true AS within_cap, total AS current FROM taken LEFT JOIN counted USING (s)",
        members="SELECT *, row_number() OVER (PARTITION BY s ORDER BY node_id) AS place FROM (SELECT DISTINCT node_id, n, node_id // 4 AS s FROM options)",
        supers="SELECT s, count(*) AS size, round(exp(sum(ln(n))))::BIGINT AS combinations FROM members GROUP BY 1",
        combos="""SELECT s, 0::BIGINT AS at, [0, 0, 0]::INT[] AS total FROM supers
            UNION ALL SELECT c.s, c.at + 1, [c.total[1] + o.v[1], c.total[2] + o.v[2], c.total[3] + o.v[3]]::INT[] FROM combos c JOIN members m ON m.s = c.s AND m.place = c.at + 1 JOIN options o ON o.node_id = m.node_id""",
        counted="SELECT c.s, count(DISTINCT total)::INT AS n_impls FROM combos c JOIN supers USING (s) WHERE c.at = size AND combinations <= 16 GROUP BY 1",
        taken="SELECT node_id // 4 AS s, [sum(v[1]), sum(v[2]), sum(v[3])]::INT[] AS total FROM chosen GROUP BY 1"),
    "hg_violations": sql("SELECT 0::BIGINT AS short_nets, 0::BIGINT AS uneven_vectors, 0::BIGINT AS bad_choices, (SELECT count(*) FROM chosen WHERE EXISTS (SELECT 1 FROM allowed WHERE chosen.v[res_id + 1] >= 2 * m))::BIGINT AS heavy_nodes"),
    "fm_partition": sql("SELECT res_id, total, greatest(1, floor(total * 0.05))::BIGINT AS bound, true AS within, 0::BIGINT AS lost, (SELECT count(DISTINCT edge_id) FROM pins)::BIGINT AS nets, true AS better FROM resources"),
    "fm_kway": sql("SELECT res_id, total, 4::BIGINT AS parts, 0::BIGINT AS lost, true AS better FROM resources"),
    "fm_cost_check": sql("SELECT r::INT AS run_id, (SELECT count(*) FROM part)::BIGINT AS nodes, true AS same_cost, sum(total) FILTER (res_id = 0)::BIGINT AS total_0, sum(total) FILTER (res_id = 1)::BIGINT AS total_1, sum(total) FILTER (res_id = 2)::BIGINT AS total_2 FROM resources, range(2) t(r) GROUP BY 1"),
    "fm_bisect_check": sql("SELECT (SELECT count(*) FROM cut WHERE crosses)::BIGINT AS start_cut, true AS better, sum(greatest(0, abs(balance) - m))::BIGINT AS start_over, false AS more_over, 0::BIGINT AS lost FROM allowed"),
    "fm_from_solution": sql("SELECT (SELECT count(*) FROM cut WHERE crosses)::BIGINT AS cut, sum(greatest(0, abs(balance) - m))::BIGINT AS over, false AS worse, 0::BIGINT AS lost, 0::BIGINT AS changed FROM allowed"),
    "hg_prefix_curve": sql("SELECT place, node_id, ((SELECT count(*) FROM cut WHERE crosses) + sum(change) OVER (ORDER BY place))::BIGINT AS cut FROM effects", **_moves),
    "hg_move_effects": sql("SELECT node_id, place, change::DOUBLE AS change FROM effects", **_moves),
    "hg_proportional_impl": sql(
        """SELECT node_id, arg_min(idx, {'cost': cost, 'idx': idx})::INT AS sel FROM (
            SELECT node_id, idx, p[1] * (v[1] / 2000000::DOUBLE) + p[2] * (v[2] / 740741::DOUBLE) + p[3] * (v[3] / 1052632::DOUBLE) AS cost
            FROM options JOIN prices ON i = 16 + (node_id * 1103515245 + 12345) % 2147483648 // 65536 % 16) GROUP BY 1""",
        prices="""SELECT 0 AS i, [1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE] AS p UNION ALL
            SELECT i + 1, list_transform([1, 2, 3], lambda r: p[r] * (1 + share[r] / list_max(share))) FROM (
                SELECT i, p, [sum(w[1]) / 2000000::DOUBLE, sum(w[2]) / 740741::DOUBLE, sum(w[3]) / 1052632::DOUBLE] AS share FROM (
                    SELECT i, p, node_id, arg_min(v, {'cost': p[1] * (v[1] / 2000000::DOUBLE) + p[2] * (v[2] / 740741::DOUBLE) + p[3] * (v[3] / 1052632::DOUBLE), 'idx': idx}) AS w FROM prices, options WHERE i < 31 GROUP BY i, p, node_id)
                GROUP BY i, p)"""),
    "hg_tops": sql("SELECT node_id, arg_max(top, height) AS top, max(height)::BIGINT AS height FROM up GROUP BY 1", **_forest),
    "hg_hierarchy": sql(
        """SELECT res_id, w_a, w_b, w_a - w_b AS balance, w_a + w_b AS total FROM (
            SELECT r::INT AS res_id, coalesce(sum(v[r + 1]) FILTER (top % 2 = 0), 0)::BIGINT AS w_a, coalesce(sum(v[r + 1]) FILTER (top % 2 <> 0), 0)::BIGINT AS w_b FROM chosen JOIN up USING (node_id), range(3) t(r) WHERE height = 3 GROUP BY 1)""", **_forest),
    "graph_xml_read": sql("SELECT 'n' || edge_id AS name, (edge_id % 9 + 1)::DOUBLE AS width, count(*)::BIGINT AS n_pins, sum(v[1] + v[2] + v[3])::BIGINT AS weight FROM pins JOIN chosen USING (node_id) GROUP BY edge_id"),
    "ts_vcd_commands": f"""WITH events_ AS (
            SELECT user_id % 8 AS dump, user_id::VARCHAR AS signal, epoch_us(ts) - 1704067200000000 AS t, event_id AS seq, CASE WHEN event_type = 'error' THEN 'x' WHEN value > 100 THEN '1' ELSE '0' END AS v FROM events),
        users AS (SELECT DISTINCT dump, signal FROM events_),
        parts AS (
            SELECT dump, 0 AS part, 0 AS t, i AS seq, 4 AS tokens, [{{'kind': 'declaration', 'at': 0, 'word': '$scope', 'value': 'module ' || n}}] AS said FROM (SELECT DISTINCT dump FROM users), (VALUES (0, 'top'), (1, 'dut')) x(i, n)
            UNION ALL SELECT dump, 1, 0, signal::BIGINT, 6, [{{'kind': 'declaration', 'at': 0, 'word': '$var', 'value': 'wire 1 @' || signal || ' ' || signal}}] FROM users
            UNION ALL SELECT dump, 2, 0, i, 2, [{{'kind': 'declaration', 'at': 0, 'word': w, 'value': ''}}] FROM (SELECT DISTINCT dump FROM users), (VALUES (0, '$upscope'), (1, '$upscope'), (2, '$enddefinitions')) x(i, w)
            UNION ALL SELECT dump, 3, t, seq, 2 + (seq % 3 = 0)::INT + 5 * (seq % 5 = 0)::INT, list_concat(
                [{{'kind': 'time', 'at': 0, 'word': NULL, 'value': NULL}}, {{'kind': 'change', 'at': 1, 'word': '@' || signal, 'value': CASE WHEN seq % 3 = 0 THEN 'b' ELSE '' END || v}}],
                CASE WHEN seq % 5 = 0 THEN [{{'kind': 'declaration', 'at': 2 + (seq % 3 = 0)::INT, 'word': '$comment', 'value': '#9 1@1 b0'}}] ELSE [] END) FROM events_),
        placed AS (SELECT *, sum(tokens) OVER (PARTITION BY dump ORDER BY part, t, seq) - tokens AS before FROM parts)
        SELECT dump, (before + x.at)::BIGINT AS seq, x.kind, t::BIGINT AS t, x.word, x.value FROM (SELECT dump, before, t, unnest(said) AS x FROM placed)""",
    "ts_vcd_extend": """SELECT p_partkey, substr(reverse(CASE WHEN p_partkey % 4 IN (0, 1) THEN lpad(d, greatest(8, length(d))::INT, d[1]) ELSE lpad(d, greatest(8, length(d))::INT, '0') END), 1, 8) AS bits
        FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'x' WHEN 1 THEN 'z' ELSE '' END || bin(p_size) AS d FROM part)""",
    "verilog_lateral": """SELECT p_partkey, 'LUT2' AS type, port, pos::INT AS pos, CASE port WHEN 'O' THEN 'n' || p_partkey WHEN 'I0' THEN CASE pos WHEN 0 THEN '1''b0' ELSE 'a[' || (p_partkey % 4) || ']' END ELSE 'bus[' || pos || ']' END AS net
        FROM part, (VALUES ('O', 0), ('I0', 0), ('I0', 1), ('I1', 0), ('I1', 1)) t(port, pos)""",
    "verilog_file": """SELECT 'wire' AS kind, n || p_partkey AS name, (p_size % 5)::INT AS high, 0 AS low FROM part, (VALUES ('w'), ('v')) t(n) UNION ALL SELECT 'input', 'i' || p_partkey, 0, 0 FROM part""",
    "verilog_buses": """SELECT p_partkey::VARCHAR AS instance, (unnest(range(p_size % 4 + 3)))::INT AS pos, 'b' || p_partkey || '[' || (unnest(range(p_size % 4 + 3)) - 1) || ']' AS net FROM part WHERE p_partkey % 2 = 0
        UNION ALL SELECT p_partkey::VARCHAR, 0, 'b' || p_partkey FROM part WHERE p_partkey % 2 = 1""",
    "fmt_bit_names": "SELECT p_partkey, 'b[' || i || ']' AS bit_name FROM (SELECT p_partkey, unnest(range(least(p_size % 3, p_size % 7 - 3), greatest(p_size % 3, p_size % 7 - 3) + 1)) AS i FROM part)",
    "fmt_without_parameters": "SELECT p_partkey, 'LUT2 u' || p_partkey || ' (.O(n' || p_partkey || '))' AS line FROM part",
    "fmt_mst": sql("""SELECT 'V' AS kind, (SELECT count(*) * 2 FROM options)::BIGINT AS n, (SELECT count(*) FROM part)::DOUBLE AS ones UNION ALL SELECT 'X', count(*), count(*) FILTER (crosses) FROM cut
        UNION ALL SELECT 'C', 2 * count(*), sum((cnt_a > 0)::INT + (cnt_b > 0)::INT) FROM cut"""),
    "fmt_dumpvars": "SELECT '$dumpvars(0, top.u' || c_custkey || ');' AS value FROM customer",
    "fmt_chaco_header": """WITH e AS (SELECT DISTINCT l_partkey + 1 AS u, l_suppkey + (SELECT max(p_partkey) FROM part) + 2 AS v, (l_partkey % 9 + 1)::INT AS weight FROM lineitem)
        SELECT weight, count(*)::BIGINT AS n, sum(u)::BIGINT AS u, (SELECT max(v) FROM e)::BIGINT AS of_nodes, (SELECT count(*) FROM e)::BIGINT AS of_edges FROM e GROUP BY 1""",
    "sim_chains": """WITH RECURSIVE steps AS (SELECT min(p_partkey) - 1 AS k, 0.5::DOUBLE AS p, 0 AS level FROM part
            UNION ALL SELECT k + 1, CASE (k + 1) % 3 WHEN 0 THEN p WHEN 1 THEN 1 - p ELSE 1 - (1 - p) * 0.75 END, level + 1 FROM steps WHERE k < (SELECT max(p_partkey) FROM part))
        SELECT 'w' || k AS wire, round(p, 6)::DOUBLE AS p1, level::INT AS level FROM steps""",
    "sim_seeded": sql(f"SELECT 'o' || c_custkey AS wire, round(CASE WHEN c_custkey % 3 = 0 THEN 0.0 ELSE coalesce({_biased}, 0.5) END, 9)::DOUBLE AS p1 FROM customer LEFT JOIN dwell ON c_custkey::VARCHAR = signal"),
    "ts_dwell": sql("SELECT * FROM dwell"),
    "ts_stream_dwell": sql("SELECT * FROM dwell"),
    "ts_vcd_dwell": sql("SELECT * FROM dwell"),
    "ts_stream_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, CASE WHEN event_type = 'error' THEN 'x' WHEN value > 100 THEN '1' ELSE '0' END AS v, count(*)::BIGINT AS n FROM events GROUP BY 1, 2",
    "ts_dwell_sliced": sql("SELECT * FROM sliced"),
    "ts_min_entropy": sql(f"SELECT signal, bit, round({h(_p)}, 9)::DOUBLE AS h FROM dwell"),
    "ts_slice_totals": sql(f"SELECT slice, count(*)::BIGINT AS n_signals, round(sum(h), 6)::DOUBLE AS total, round(avg(h), 6)::DOUBLE AS mean FROM (SELECT slice, {h(_p)} AS h FROM sliced) GROUP BY 1"),
    "ts_biased_p1": sql(f"SELECT signal, round({_biased}, 9)::DOUBLE AS p1 FROM dwell"),
    "ts_probabilities": sql("SELECT signal, " + ", ".join(f"round(CASE WHEN n0 + n1 + nx + nz = 0 THEN 0.0 ELSE n{s} / (n0 + n1 + nx + nz) END, 9)::DOUBLE AS p{s}" for s in "01xz") + " FROM dwell"),
    "ts_compare": sql("""SELECT CASE WHEN o.signal::BIGINT % 2 = 0 THEN '\\' || o.signal || ' ' ELSE o.signal END AS signal, round(o.h - g.h, 9)::DOUBLE AS diff, abs(round(o.h - g.h, 9))::DOUBLE AS abs_diff FROM other o JOIN gold g USING (signal)"""),
    "ts_unmatched": sql("SELECT count(*) FILTER (g.signal IS NOT NULL AND o.signal IS NOT NULL)::BIGINT AS matched, count(*) FILTER (o.signal IS NULL)::BIGINT AS gold_only, count(*) FILTER (g.signal IS NULL)::BIGINT AS other_only FROM (SELECT * FROM gold WHERE signal::BIGINT % 3 <> 0) g FULL JOIN (SELECT * FROM other) o USING (signal)"),
    "ts_whitelist": sql("SELECT * FROM gold WHERE signal IN (SELECT c_custkey::VARCHAR FROM customer WHERE c_custkey % 7 = 0)"),
    "ts_whitelist_missing": sql("SELECT c_custkey::VARCHAR AS signal FROM customer WHERE c_custkey % 7 = 0 AND c_custkey::VARCHAR NOT IN (SELECT signal FROM gold)"),
    "ts_entropy_bins": sql("""SELECT bin::INT AS bin, count(*)::BIGINT AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS percent FROM (
        SELECT CASE WHEN h >= 0.99 THEN 1 WHEN h >= 0.95 THEN 2 WHEN h >= 0.9 THEN 3 WHEN h >= 0.75 THEN 4 WHEN h >= 0.5 THEN 5 WHEN h >= 0.25 THEN 6 WHEN h >= 0.1 THEN 7 ELSE 8 END AS bin FROM gold) GROUP BY 1"""),
    "fmt_ntl_roundtrip": "SELECT 'u' || s_suppkey AS instance, 'LUT' || (s_nationkey % 6) AS type, count(*)::BIGINT AS n_wires, min(w) AS first, round(sum(length(w) / 4.0), 6)::DOUBLE AS entropy FROM supplier JOIN (SELECT DISTINCT l_suppkey, 'w' || l_partkey AS w FROM lineitem) ON l_suppkey = s_suppkey GROUP BY 1, 2",
    "fmt_ntl_hypergraph": "SELECT 'n' || s AS net, count(*)::BIGINT AS n_pins, count(*)::BIGINT AS degree, (s % 10) / 10.0::DOUBLE AS entropy FROM (SELECT DISTINCT l_partkey AS p, l_orderkey AS s FROM lineitem) GROUP BY s HAVING count(*) <= 4",
    "fmt_ntl_nodes": "SELECT 'u' || p_partkey AS instance, p_brand AS type, 2 AS n_impls, least_size::INT AS first, least_size::INT AS second FROM (SELECT *, min(p_size) OVER (PARTITION BY p_brand) AS least_size FROM part)",
    "fmt_impl_library": "SELECT replace(p_type, ' ', '_') AS type, 2 AS n_impls, arg_min(p_size, p_partkey)::INT AS first, arg_min(p_size, p_partkey)::INT AS last FROM part GROUP BY 1",
    "fmt_chaco_roundtrip": "SELECT DISTINCT l_partkey + 1 AS u, l_suppkey + 1000001 AS v, ((l_partkey + 1) % 9 + 1)::INT AS weight FROM lineitem",
    "fmt_weight_file": sql("SELECT node_id, count(*)::INT AS n_impls, sum(list_sum(v))::INT AS weight_sum FROM options GROUP BY 1"),
    "fmt_entropy_counts": sql("SELECT signal || '[0]' AS name, (row_number() OVER (PARTITION BY signal ORDER BY slice) - 1)::INT AS slice, n0, n1, nx, nz FROM sliced"),
    "fmt_shannon": sql("SELECT signal AS name, 0 AS slice, h::DOUBLE AS h FROM gold"),
    "fmt_seed_p1": sql(f"SELECT CASE WHEN c_custkey % 2 = 0 THEN signal || '[0]' ELSE '\\' || signal || ' [0]' END AS wire, round({_biased}, 9)::DOUBLE AS p1 FROM dwell JOIN customer ON c_custkey::VARCHAR = signal"),
    "fmt_tokens": "SELECT token, count(*)::BIGINT AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS token FROM part) GROUP BY 1",
    "fmt_bit_range_expand": "SELECT p_partkey, 'bus' || p_partkey || '[' || i || ']' AS bit_name FROM (SELECT p_partkey, unnest(range(least(p_size % 7 - 2, p_size % 3), greatest(p_size % 7 - 2, p_size % 3) + 1)) AS i FROM part)",
    "fmt_split_name_clean": "SELECT 'net' || (p_partkey % 50) AS base, count(*)::BIGINT AS n, max('net' || (p_partkey % 50) || '_split_' || p_partkey) AS last FROM part GROUP BY 1",
    "fmt_escape": f"SELECT p_partkey, {_escape('raw')} AS escaped FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 's' || p_partkey || '[' || p_size || ']' WHEN p_partkey % 3 = 1 THEN '\\s' || p_partkey || ' ' ELSE 's' || p_partkey END AS raw FROM part)",
    "fmt_immediate": "SELECT p_partkey, p_partkey AS value FROM part",
    "fmt_mps_name": f"SELECT o_orderkey, {_vname('o_orderkey')} AS name FROM orders",
    "fmt_net_blacklist": "SELECT c_custkey, CASE c_custkey % 40 WHEN 6 THEN 'RST' WHEN 7 THEN 'clk' WHEN 8 THEN 'CLK_IBUF_BUFG[0]' WHEN 9 THEN '\\<const1> [0]' WHEN 13 THEN 'VCC_2[0]' ELSE 'n' || c_custkey END AS net FROM customer WHERE c_custkey % 40 IN (6, 7, 8, 9, 13) OR c_custkey % 40 > 14 AND c_custkey % 40 <> 20",
    "fmt_wire_blacklist": "SELECT c_custkey, CASE c_custkey % 40 WHEN 7 THEN 'clk' WHEN 12 THEN '\\<const1>' ELSE 'n' || c_custkey END AS net FROM customer WHERE c_custkey % 40 IN (7, 12) OR c_custkey % 40 > 14 AND c_custkey % 40 <> 20",
    "fmt_code_lengths": "SELECT symbol, count(*)::BIGINT AS n, round(-log2(count(*) / sum(count(*)) OVER ()), 9)::DOUBLE AS bits FROM (SELECT CASE WHEN event_type = 'error' THEN 'x' WHEN value > 100 THEN '1' ELSE '0' END AS symbol FROM events) GROUP BY 1",
    "fmt_testbench": """SELECT '\\n' || p_partkey || ' ' AS net, 'initial $strobe("\\\\n' || p_partkey || ' =%b", \\n' || p_partkey || ' );' AS value FROM part WHERE p_partkey % 2 = 0""",
    "verilog_parse": """SELECT 'LUT2' AS type, port, sum(bits)::BIGINT AS n, count(*)::BIGINT AS instances, CASE port WHEN 'O' THEN count(*) WHEN 'I0' THEN 1 + count(DISTINCT p_partkey % 4) ELSE 2 END::BIGINT AS nets
        FROM part, (VALUES ('O', 1), ('I0', 2), ('I1', 2)) t(port, bits) GROUP BY port""",
    "sim_lut_prob": f"SELECT p_partkey, round({_lut2(_ps[0], _ps[1], '(p_partkey % 16)')}, 9)::DOUBLE AS p1 FROM part",
    "sim_mux_prob": f"SELECT p_partkey, round({_mux}, 9)::DOUBLE AS p1, round({h(_mux + '::DOUBLE')}, 9)::DOUBLE AS h FROM part",
    "sim_carry": """SELECT p_partkey, round(c1, 9)::DOUBLE AS co0, round(s0 * (1 - c0) + c0 * (1 - s0), 9)::DOUBLE AS o0, round(s1 * c1 + (1 - s1) * d1, 9)::DOUBLE AS co1, round(s1 * (1 - c1) + c1 * (1 - s1), 9)::DOUBLE AS o1 FROM (
        SELECT *, s0 * c0 + (1 - s0) * d0 AS c1 FROM (SELECT p_partkey, @0 AS c0, @1 AS d0, @2 AS s0, @2 AS d1, @0 AS s1 FROM part))""".replace("@0", f"({_ps[0]})::DOUBLE").replace("@1", f"({_ps[1]})::DOUBLE").replace("@2", f"({_ps[2]})::DOUBLE"),
    "sim_cells": f"SELECT p_partkey, round(CASE WHEN p_partkey % 11 = 0 THEN 0.0 WHEN p_partkey % 11 = 1 THEN 1.0 WHEN p_partkey % 11 IN (3, 7, 8) THEN 0.5 WHEN p_partkey % 11 = 6 THEN 1 - {_ps[0]} ELSE {_ps[0]} END, 9)::DOUBLE AS p1 FROM part",
    "sim_bus_entropy": f"SELECT p_partkey, round({' + '.join(h(f'({p})::DOUBLE') for p in _ps)}, 9)::DOUBLE AS h FROM part",
    "ilp_vars": sql(f"""SELECT 'V' || {_vname('node_id')} || side || idx AS name, 0.0::DOUBLE AS obj FROM options, (VALUES ('A'), ('B')) t(side)
        UNION ALL SELECT 'X' || {_vname('edge_id')}, 1.0 FROM nets UNION ALL SELECT 'C' || {_vname('edge_id')} || side, 0.0 FROM nets, (VALUES ('A'), ('B')) t(side)""", nets="SELECT DISTINCT edge_id FROM pins"),
    "ilp_rows": sql(f"""SELECT 'B' || r || side AS name, '>=' AS sense, 0.0::DOUBLE AS rhs FROM range(3) t(r), (VALUES ('A'), ('B')) u(side)
        UNION ALL SELECT 'N' || {_vname('p_partkey')}, '=', 1.0 FROM part
        UNION ALL SELECT k || '_' || {_vname('edge_id')}, s, b FROM nets, (VALUES ('L', '>=', -1.0), ('U', '<=', 0.0), ('TA', '>=', 0.0), ('TB', '>=', 0.0), ('SA', '<=', 0.0), ('SB', '<=', 0.0)) t(k, s, b)""", nets="SELECT DISTINCT edge_id FROM pins"),
    "ilp_coef": sql(f"""SELECT 'B' || r || s AS row, 'V' || {_vname('node_id')} || side || idx AS variable, round(v[r + 1] * (0.01::DOUBLE + CASE WHEN s = side THEN -1 ELSE 1 END), 9)::DOUBLE AS val
            FROM options, range(3) t(r), (VALUES ('A'), ('B')) u(side), (VALUES ('A'), ('B')) w(s) WHERE v[r + 1] <> 0
        UNION ALL SELECT 'N' || {_vname('node_id')}, 'V' || {_vname('node_id')} || side || idx, 1.0 FROM options, (VALUES ('A'), ('B')) u(side)
        UNION ALL SELECT r || '_' || {_vname('edge_id')}, k || {_vname('edge_id')} || p, val FROM nets, (VALUES ('L'), ('U')) t(r), (VALUES ('X', '', 2.0), ('C', 'A', -1.0), ('C', 'B', -1.0)) u(k, p, val)
        UNION ALL SELECT k || side || '_' || {_vname('edge_id')}, 'V' || {_vname('pins.node_id')} || side || idx, -1.0 FROM pins JOIN options USING (node_id), (VALUES ('A'), ('B')) u(side), (VALUES ('T'), ('S')) w(k)
        UNION ALL SELECT k || side || '_' || {_vname('edge_id')}, 'C' || {_vname('edge_id')} || side, CASE WHEN k = 'T' THEN m ELSE 1 END::DOUBLE FROM (SELECT edge_id, count(*) AS m FROM pins JOIN options USING (node_id) GROUP BY 1), (VALUES ('A'), ('B')) u(side), (VALUES ('T'), ('S')) w(k)""", nets="SELECT DISTINCT edge_id FROM pins"),
    "ilp_size": sql("SELECT (SELECT count(*) * 2 FROM options)::BIGINT AS node_variables, (SELECT count(DISTINCT edge_id) * 3 FROM pins)::BIGINT AS edge_variables, (SELECT count(*) FROM part)::BIGINT AS node_rows, (SELECT 2 * (count(DISTINCT edge_id) * 4 + count(*)) FROM pins)::BIGINT AS edge_rows"),
    "ilp_solution": sql(f"""SELECT 'V' || {_vname('node_id')} || side || idx || CASE WHEN idx = node_id % n AND (node_id % 2 = 0) = (side = 'A') THEN ' 1' ELSE ' 0' END || chr(9) || ' (obj:0)' AS value FROM options, (VALUES ('A'), ('B')) u(side)
        UNION ALL SELECT 'X' || {_vname('edge_id')} || CASE WHEN crosses THEN ' 1' || chr(9) || ' (obj:1)' ELSE ' 0' || chr(9) || ' (obj:0)' END FROM cut
        UNION ALL SELECT 'C' || {_vname('edge_id')} || side || CASE WHEN (CASE WHEN side = 'A' THEN cnt_a ELSE cnt_b END) > 0 THEN ' 1' ELSE ' 0' END || chr(9) || ' (obj:0)' FROM cut, (VALUES ('A'), ('B')) u(side)"""),
    "ilp_feasible": sql("""SELECT 'B' AS kind, count(*)::BIGINT AS n, count(*) FILTER (lhs < -1e-6)::BIGINT AS broken FROM (SELECT 0.01 * total - balance AS lhs FROM resources UNION ALL SELECT 0.01 * total + balance FROM resources)
        UNION ALL SELECT 'N', count(*)::BIGINT, 0 FROM part UNION ALL SELECT k, (m * (SELECT count(DISTINCT edge_id) FROM pins))::BIGINT, 0 FROM (VALUES ('L', 1), ('U', 1), ('T', 2), ('S', 2)) t(k, m)"""),
    "sim_cells_propagate": f"""WITH RECURSIVE steps AS (SELECT 3 AS i, [0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE] AS p
            UNION ALL SELECT i + 1, list_append(p, CASE i % 7 WHEN 0 THEN {_lut2('a', 'b', '(i % 16)')} WHEN 1 THEN 1 - a WHEN 2 THEN c * b + (1 - c) * a WHEN 3 THEN a WHEN 4 THEN c * (1 - a) + a * (1 - c) WHEN 5 THEN 0.0 ELSE 1.0 END)
            FROM (SELECT *, p[(i - 1) // 2 + 1] AS a, p[(i - 2) // 3 + 1] AS b, p[(i - 3) // 4 + 1] AS c FROM steps) WHERE i <= (SELECT max(p_partkey) FROM part)),
        wires AS (SELECT unnest(range(len(p))) AS k, unnest(p) AS p FROM steps WHERE i = (SELECT max(p_partkey) FROM part) + 1),
        loops AS (SELECT l.k, a.p AS a, 1 - 0.5 * (1 - b.p) AS second FROM wires l JOIN wires a ON a.k = (l.k - 1) // 2 JOIN wires b ON b.k = (l.k - 2) // 3 WHERE l.k >= 3 AND l.k % 10 = 0)
        SELECT 'w' || k AS wire, round(p, 9)::DOUBLE AS p1 FROM wires UNION ALL SELECT 'l' || k || 'a', round(second * a, 9) FROM loops UNION ALL SELECT 'l' || k || 'b', round(second, 9) FROM loops""",
    "sim_propagate": f"""WITH RECURSIVE steps AS (SELECT 2 AS i, [0.5::DOUBLE, 0.5::DOUBLE] AS p
            UNION ALL SELECT i + 1, list_append(p, {_lut2('p[(i - 1) // 2 + 1]', 'p[(i - 2) // 3 + 1]', '(i % 16)')}) FROM steps WHERE i <= (SELECT max(p_partkey) FROM part)),
        wires AS (SELECT unnest(range(len(p))) AS k, unnest(p) AS p FROM steps WHERE i = (SELECT max(p_partkey) FROM part) + 1)
        SELECT k::VARCHAR AS wire, round(p, 9)::DOUBLE AS p1, round({h('p')}, 9)::DOUBLE AS h FROM wires""",
}
