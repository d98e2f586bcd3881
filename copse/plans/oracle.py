"""Building blocks of the SQL counterparts: named common table expressions, put together by name."""

from __future__ import annotations


def frame_sql(table: str) -> str:
    if table == "orders":
        return """fr AS (SELECT o_orderkey AS rid, o_totalprice AS f0, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS f1,
            CAST(month(o_orderdate) AS DOUBLE) AS f2, CAST(year(o_orderdate) AS DOUBLE) AS f3,
            CAST(o_orderstatus = 'F' AS INT)::DOUBLE AS y, o_orderstatus AS status, 1.0::DOUBLE AS w FROM orders)"""
    return """fr AS (SELECT c_custkey AS rid, CAST(c_nationkey AS DOUBLE) AS f0, c_acctbal AS f1, CAST(length(c_mktsegment) AS DOUBLE) AS f2,
            CAST(c_custkey % 3 = 0 AS INT)::DOUBLE AS y, c_mktsegment AS segment, 1.0::DOUBLE AS w FROM customer)"""


def long_sql(p: int, source: str = "fr", where: str = "") -> str:
    parts = " UNION ALL ".join(f"SELECT rid, y, w, {i} AS feature, f{i} AS v FROM {source} {where}" for i in range(p))
    return f"lg AS ({parts})"


EDGES = """fn AS (SELECT feature, count(*) AS n, least(count(DISTINCT v), 256) AS bins FROM lg GROUP BY feature),
    rk AS (SELECT feature, v, row_number() OVER (PARTITION BY feature ORDER BY v) - 1 AS r FROM lg),
    pick AS (SELECT feature, (b * n) // bins AS r FROM fn, range(1, 256) t(b) WHERE b < bins),
    ed0 AS (SELECT DISTINCT feature, v AS edge FROM pick JOIN rk USING (feature, r) UNION SELECT DISTINCT feature, 'Infinity'::DOUBLE FROM lg),
    ed AS (SELECT feature, CAST(row_number() OVER (PARTITION BY feature ORDER BY edge) - 1 AS INT) AS bin, edge FROM ed0)"""

BINNED = "bn AS (SELECT lg.rid, lg.y, lg.w, lg.feature, lg.v, coalesce(e.bin + 1, 0) AS bin FROM lg ASOF LEFT JOIN ed e ON lg.feature = e.feature AND lg.v > e.edge)"


def hist_sql(sums: list[str], source: str = "bn", key: str = "bin", group: str = "0", name: str = "h", where: str = "") -> str:
    """Histogram by (node, feature, bin): n, w, s0.. from expressions over y and w."""
    cols = ", ".join(f"sum({s}) AS s{i}" for i, s in enumerate(sums))
    return f"{name} AS (SELECT {group} AS node, feature, {key} AS bin, count(*) AS n, sum(w) AS w, {cols} FROM {source} {where} GROUP BY ALL)"


def cand_sql(width: int, classification: bool, exact: bool = False, extra: str = "", name: str = "c", hist: str = "h") -> str:
    """Candidates with gains, and the best split of each node under <name>best."""
    names = ["n", "w", *[f"s{i}" for i in range(width)]]
    lefts = ", ".join(f"sum({x}) OVER (PARTITION BY node, feature ORDER BY bin ROWS UNBOUNDED PRECEDING) AS l{x}, sum({x}) OVER (PARTITION BY node, feature) AS t{x}" for x in names)
    rights = ", ".join(f"t{x} - l{x} AS r{x}" for x in names)
    thr = "(bin + lead(bin) OVER (PARTITION BY node, feature ORDER BY bin)) / 2" if exact else "bin"
    if classification:
        imp = {s: "(1.0 - " + " - ".join(f"({s}s{i} / {s}w) * ({s}s{i} / {s}w)" for i in range(width)) + ")" for s in "tlr"}
    else:
        imp = {s: f"({s}s1 / {s}w - ({s}s0 / {s}w) * ({s}s0 / {s}w))" for s in "tlr"}
    return f"""{name}0 AS (SELECT *, {thr} AS thr, {lefts} FROM {hist}), {name}1 AS (SELECT *, {rights} FROM {name}0),
    {name} AS (SELECT *, {imp['t']} AS parent, {imp['t']} - (lw * {imp['l']} + rw * {imp['r']}) / tw AS gain FROM {name}1
        WHERE ln >= 1 AND rn >= 1 AND lw > 0 AND rw > 0 {extra}),
    {name}best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, feature, bin) AS place FROM {name} WHERE gain > 1e-12 * greatest(1.0, parent)) WHERE place = 1)"""


GINI2 = ["CASE WHEN y = 0 THEN w ELSE 0.0 END", "CASE WHEN y = 1 THEN w ELSE 0.0 END"]
MOMENTS = ["w * y", "w * y * y"]


def draw_sql(seed: int, *parts: str) -> str:
    inner = " || ':' || ".join([f"'{seed}'", *[f"CAST({p} AS VARCHAR)" for p in parts]])
    return f"('0x' || substr(md5({inner}), 1, 15))::BIGINT"


def wilson_sql(p: str, n: str, z: float = 1.96) -> tuple[str, str]:
    z2 = z * z
    centre = f"(({p} + {z2} / (2 * {n})) / (1 + {z2} / {n}))"
    half = f"({z} * sqrt({p} * (1 - {p}) / {n} + {z2} / (4 * {n} * {n})) / (1 + {z2} / {n}))"
    return f"greatest({centre} - {half}, 0.0)", f"least({centre} + {half}, 1.0)"


def forest_sql(p: str, seed: int, n_trees: int, depth: int, target: str, classification: bool = False, boot: bool = True, pick: int = 0, n_features: int = 4, exact: bool = False, rising: int | None = None, beside: str | None = None) -> list[str]:
    """Trees grown level by level over bn and target (rid, y, w), each node keyed by tree * 1000 + heap id.

    p..mean has the mean over trees of each row's leaf value v, p..nodes the nodes. pick: features tried at a node, by draw.
    exact: split at midpoints of values; rising: a feature whose leaf values may not fall; beside: rows (rid) that are scored and not fitted.
    """
    sums = GINI2 if classification else MOMENTS
    cols = ", ".join(f"sum(({x.replace('THEN w', 'THEN t.w').replace('w * y', 't.w * t.y').replace('* y', '* t.y').replace('y =', 't.y =').replace('t.t.y', 't.y')}) * n.m) AS s{k}" for k, x in enumerate(sums))
    out = [
        f"{p}cu AS (SELECT rid, row_number() OVER (ORDER BY rid) - 1 AS rank, count(*) OVER () AS n FROM {target})",
        f"{p}dr AS (SELECT CAST(id // n AS INT) AS tree, {draw_sql(seed, chr(39) + 'boot' + chr(39), 'id')} % n AS rank FROM (SELECT DISTINCT n FROM {p}cu), range(0, {n_trees} * (SELECT count(*) FROM {target})) t(id))",
        f"{p}bt AS (SELECT tree, rank, count(*) AS m FROM {p}dr GROUP BY ALL)",
        f"{p}n0 AS (SELECT CAST(a.tree AS INT) AS tree, c.rid, CAST(a.tree * 1000 AS BIGINT) AS node, {'coalesce(b.m, 0)' if boot else '1'} AS m FROM {p}cu c CROSS JOIN range(0, {n_trees}) a(tree) LEFT JOIN {p}bt b ON b.tree = a.tree AND b.rank = c.rank)",
    ]
    if beside:
        out[-1] = out[-1][:-1] + f" UNION ALL SELECT CAST(a.tree AS INT), s.rid, CAST(a.tree * 1000 AS BIGINT), 0 FROM {beside} s CROSS JOIN range(0, {n_trees}) a(tree))"
    extra = "" if rising is None else f"AND (feature <> {rising} OR ls0 / lw <= rs0 / rw)"
    out.append(f"{p}b0 AS (SELECT DISTINCT node, '-Infinity'::DOUBLE AS lo, 'Infinity'::DOUBLE AS hi FROM {p}n0)")
    if pick:
        out.append(f"{p}sub AS (SELECT tree * 1000 + node AS node, feature FROM (SELECT *, row_number() OVER (PARTITION BY tree, node ORDER BY {draw_sql(seed, chr(39) + 'feat' + chr(39), 'tree', 'node', 'feature')}, feature) AS r FROM range(0, {n_trees}) a(tree), range(0, {2**depth}) b(node), range(0, {n_features}) c(feature)) WHERE r <= {pick})")
        extra = f"AND (node, feature) IN (SELECT (node, feature) FROM {p}sub)"
    for d in range(depth):
        out += [
            f"{p}h{d} AS (SELECT n.node, bn.feature, bn.{"v" if exact else "bin"} AS bin, CAST(sum(n.m) AS BIGINT) AS n, sum(t.w * n.m) AS w, {cols} FROM {p}n{d} n JOIN bn ON bn.rid = n.rid JOIN {target} t ON t.rid = n.rid WHERE n.m > 0 GROUP BY ALL)",
            cand_sql(2, classification, exact, name=f"{p}c{d}", hist=f"{p}h{d}", extra=extra),
            f"{p}n{d + 1} AS (SELECT n.tree, n.rid, CASE WHEN b.feature IS NULL THEN n.node WHEN x.{"v" if exact else "bin"} <= b.thr THEN n.tree * 1000 + 2 * (n.node - n.tree * 1000) + 1 ELSE n.tree * 1000 + 2 * (n.node - n.tree * 1000) + 2 END AS node, n.m FROM {p}n{d} n LEFT JOIN {p}c{d}best b ON b.node = n.node LEFT JOIN bn x ON x.rid = n.rid AND x.feature = b.feature)",
        ]
        root, mid = "(b.node // 1000) * 1000 + 2 * (b.node % 1000)", "least(greatest((c.ls0 / c.lw + c.rs0 / c.rw) / 2, b.lo), b.hi)"
        held = "false" if rising is None else f"c.feature = {rising}"
        out.append(f"{p}b{d + 1} AS (SELECT CASE WHEN c.node IS NULL THEN b.node ELSE {root} + s.side END AS node, CASE WHEN {held} AND s.side = 2 THEN {mid} ELSE b.lo END AS lo, CASE WHEN {held} AND s.side = 1 THEN {mid} ELSE b.hi END AS hi FROM {p}b{d} b LEFT JOIN {p}c{d}best c ON c.node = b.node JOIN (VALUES (1), (2)) s(side) ON c.node IS NOT NULL OR s.side = 1)")
    splits = " UNION ALL ".join(f"SELECT node, CAST(feature AS INT) AS feature, {"thr" if exact else "CAST(bin AS INT)"} AS bin, CAST(tn AS BIGINT) AS samples FROM {p}c{d}best" for d in range(depth))
    out += [
        f"{p}sp AS ({splits})",
        f"{p}lv AS (SELECT n.node, least(greatest(sum(t.w * n.m * t.y) / sum(t.w * n.m), any_value(b.lo)), any_value(b.hi)) AS v, CAST(sum(n.m) AS BIGINT) AS samples FROM {p}n{depth} n JOIN {target} t ON t.rid = n.rid JOIN {p}b{depth} b ON b.node = n.node WHERE n.m > 0 GROUP BY n.node)",
        f"{p}nodes AS (SELECT node, feature, bin, samples, false AS is_leaf FROM {p}sp UNION ALL SELECT node, -1, NULL, samples, true FROM {p}lv)",
        f"{p}mean AS (SELECT n.rid, avg(l.v) AS v FROM {p}n{depth} n JOIN {p}lv l ON l.node = n.node GROUP BY n.rid)",
    ]
    return out


def unlimited_sql(p: str, start: str, exact: bool = False, target: str = "fr", classification: bool = True, depth: int | None = None) -> list[str]:
    """Trees grown until no split is left (or to a depth), over bn and target (rid, y, w), as one recursive step: p..rows(rid, node, depth, m) has every node that a row passes.

    start: rows (rid, node, m) at the roots; a node is its tree's number plus 16 times its heap id.
    """
    key = "v" if exact else "bin"
    sums = [f"sum(CASE WHEN t.y = {k} THEN t.w * st.m ELSE 0.0 END)" for k in (0, 1)] if classification else ["sum(t.w * st.m * t.y)", "sum(t.w * st.m * t.y * t.y)"]
    cols = ", ".join(f"{x} AS s{i}" for i, x in enumerate(sums))
    hist = f"h AS (SELECT st.node, bn.feature, bn.{key} AS bin, CAST(sum(st.m) AS BIGINT) AS n, sum(t.w * st.m) AS w, {cols} FROM {p}rows st JOIN bn USING (rid) JOIN {target} t USING (rid) WHERE st.m > 0 GROUP BY ALL)"
    child = f"CAST((st.node % 16) + 16 * (2 * (st.node // 16) + CASE WHEN x.{key} <= b.thr THEN 1 ELSE 2 END) AS BIGINT)"
    step = f"WITH {hist}, {cand_sql(2, classification, exact, name='c', hist='h')} SELECT st.rid, {child}, st.depth + 1, st.m FROM {p}rows st JOIN cbest b ON b.node = st.node JOIN bn x ON x.rid = st.rid AND x.feature = b.feature"
    if depth is not None:
        step += f" WHERE st.depth < {depth}"
    return [f"{p}rows(rid, node, depth, m) AS (SELECT rid, CAST(node AS BIGINT), 0, CAST(m AS BIGINT) FROM ({start}) UNION ALL SELECT * FROM ({step}))"]


def bagged_mean_sql(p: str, seed: int, n_trees: int, depth: int, target: str) -> list[str]:
    """p..mean(rid, v): the mean over bagged regression trees of each row's leaf value, by one recursive step."""
    start = f"SELECT c.rid, a.tree AS node, coalesce(b.m, 0) AS m FROM {p}cu c CROSS JOIN range(0, {n_trees}) a(tree) LEFT JOIN {p}bt b ON b.tree = a.tree AND b.rank = c.rank"
    return [
        f"{p}cu AS (SELECT rid, row_number() OVER (ORDER BY rid) - 1 AS rank, count(*) OVER () AS n FROM {target})",
        f"{p}dr AS (SELECT CAST(id // n AS INT) AS tree, {draw_sql(seed, chr(39) + 'boot' + chr(39), 'id')} % n AS rank FROM (SELECT DISTINCT n FROM {p}cu), range(0, {n_trees} * (SELECT count(*) FROM {target})) t(id))",
        f"{p}bt AS (SELECT tree, rank, count(*) AS m FROM {p}dr GROUP BY ALL)",
        *unlimited_sql(p, start, target=target, classification=False, depth=depth),
        f"{p}lf AS (SELECT rid, node % 16 AS tree, arg_max(node, depth) AS node FROM {p}rows GROUP BY rid, node % 16)",
        f"{p}lv AS (SELECT l.node, sum(t.w * r.m * t.y) / sum(t.w * r.m) AS v FROM {p}lf l JOIN {p}rows r ON r.rid = l.rid AND r.node = l.node JOIN {target} t ON t.rid = l.rid WHERE r.m > 0 GROUP BY l.node)",
        f"{p}mean AS (SELECT l.rid, avg(v.v) AS v FROM {p}lf l JOIN {p}lv v USING (node) GROUP BY l.rid)",
    ]


def kept(sql: str) -> str:
    """The same query with each named step computed once."""
    return sql.replace(" AS (SELECT", " AS MATERIALIZED (SELECT")


def query(*ctes: str, final: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(ctes) + " " + final
