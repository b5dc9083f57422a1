"""The registered queries as SQL over the same tables."""

from __future__ import annotations

from .functions.names import OWL, RDF, RDF_TYPE, RDFS, XSD

CNS = "http://example.org/orders/schema#"
ENS = "http://example.org/orders/data/"

COLUMNS = {
    "region": ["r_regionkey", "r_name$"],
    "nation": ["n_nationkey", "n_name$", "n_regionkey"],
    "customer": ["c_custkey", "c_name$", "c_nationkey", "c_acctbal", "c_mktsegment$"],
    "supplier": ["s_suppkey", "s_name$", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name$", "p_brand$", "p_type$", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus$", "o_totalprice", "o_orderdate@", "o_orderpriority$"],
    "lineitem": [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
        "l_tax", "l_returnflag$", "l_linestatus$", "l_shipdate@",
    ],
    "events": ["event_id", "ts@", "user_id", "event_type$", "value", "props$"],
    "documents": ["doc_id", "text$", "lang$", "source$", "n_chars"],
    "pages": ["page_id", "url$", "html$"],
    "benchmark": ["item_id", "text$"],
    "labels": ["doc_id", "quality", "toxic"],
    "conversations": ["conv_id", "turn", "role$", "text$"],
}
"""Columns in order; ``$`` marks text and ``@`` timestamps."""


def detected(column: str) -> str:
    """The type of one column as an aggregate."""
    c = column.rstrip("$@")
    if column.endswith("@"):
        return f"CASE WHEN count({c}) = 0 THEN 'categorical' ELSE 'date' END"
    if not column.endswith("$"):
        return f"CASE WHEN count({c}) = 0 THEN 'categorical' ELSE 'numeric' END"
    n, u = f"count({c})", f"count(DISTINCT {c})"
    named = f"regexp_matches('{c}', 'id|name|title|key|code|identifier|uuid')"
    return (
        f"CASE WHEN {n} = 0 THEN 'categorical' "
        f"WHEN count(TRY_CAST({c} AS DOUBLE)) > 0.8 * {n} THEN 'numeric' "
        f"WHEN count(TRY_CAST({c} AS TIMESTAMP)) > 0.8 * {n} THEN 'date' "
        f"WHEN {u} > 0.95 * {n} OR ({u} > 100 AND {u} > 0.5 * {n}) OR ({named} AND {u} > 0.8 * {n}) "
        f"THEN 'title_id' ELSE 'categorical' END"
    )


def types(table: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{c.rstrip('$@')}' AS column_name, CAST({i} AS INTEGER) AS ordinal, "
        f"{detected(c)} AS detected_type FROM {table}"
        for i, c in enumerate(COLUMNS[table])
    )


def union(parts) -> str:
    return " UNION ALL ".join(parts)


def numbers(table: str, column: str, extra: str = "", where: str = "") -> str:
    return (
        f"SELECT {extra}'{column}' AS column_name, count({column}) AS n, count(*) - count({column}) AS missing, "
        f"round(avg({column}), 4) AS mean, round(median(CAST({column} AS DOUBLE)), 4) AS median, "
        f"round(stddev_samp({column}), 4) AS std, round(CAST(min({column}) AS DOUBLE), 4) AS lo, "
        f"round(CAST(max({column}) AS DOUBLE), 4) AS hi FROM {table} {where}"
    )


def days(table: str, column: str) -> str:
    return (
        f"SELECT '{column}' AS column_name, count({column}) AS n, count(*) - count({column}) AS missing, "
        f"strftime(min({column}), '%Y-%m-%d') AS min_date, strftime(max({column}), '%Y-%m-%d') AS max_date, "
        f"CAST(floor((epoch_us(max({column})) - epoch_us(min({column}))) / 86400000000) AS BIGINT) AS range_days "
        f"FROM {table}"
    )


def top(table: str, column: str, k: int = 10, where: str = "") -> str:
    return (
        f"SELECT '{column}' AS column_name, n_unique, value, n FROM (SELECT {column} AS value, count(*) AS n, "
        f"count(*) OVER () AS n_unique, row_number() OVER (ORDER BY count(*) DESC, {column}) AS k "
        f"FROM {table} {where} GROUP BY {column} HAVING {column} IS NOT NULL) WHERE k <= {k}"
    )


def top_text(table: str, column: str, k: int, where: str = "") -> str:
    return f"(SELECT string_agg(value || ':' || n, '|' ORDER BY n DESC, value) FROM ({top(table, column, k, where)}))"


# -- the orders taxonomy ------------------------------------------------------

A = "o_totalprice >= 300000"
B = "o_orderpriority = '1-URGENT'"
L = "o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderstatus = 'F'"


def members(a: str = A, b: str = B, late: str = L) -> dict[str, str]:
    """The condition of each concept."""
    return {
        "c0": "true",
        "c1": f"({a})",
        "c2": f"({b})",
        "c3": f"NOT ({a}) AND NOT ({b})",
        "c4": f"({a}) OR ({b})",
        "c5": f"({a}) AND ({b})",
        "c6": f"({a}) AND {late}",
        "c7": f"({a}) AND NOT ({late})",
    }


CHILDREN = {"c0": ["c1", "c2", "c3", "c4"], "c1": ["c5", "c6", "c7"], "c2": ["c5"], "c4": ["c1", "c2"]}
PARENTS = {
    "c0": "", "c1": "c0,c4", "c2": "c0,c4", "c3": "c0", "c4": "c0", "c5": "c1,c2", "c6": "c1", "c7": "c1",
}
NAMES = {
    "c0": "Root", "c1": "Expensive", "c2": "Urgent", "c3": "", "c4": "", "c5": "Urgent Expensive", "c6": "Late", "c7": "",
}
LOCAL = {
    "c0": "Root", "c1": "Expensive", "c2": "Urgent", "c3": "c01", "c4": "c02", "c5": "Urgent_Expensive", "c6": "Late", "c7": "c03",
}
ORIGIN = {
    "c0": "root", "c1": "restriction", "c2": "restriction", "c3": "complement", "c4": "union",
    "c5": "intersection", "c6": "restriction", "c7": "complement",
}


def covered(i: str, where: dict[str, str], children: dict[str, list[str]]) -> str:
    kids = [k for k in children.get(i, []) if k in where]
    if not kids:
        return "CAST(0 * count(*) AS DOUBLE)"
    any_kid = " OR ".join(f"({where[k]})" for k in kids)
    return (
        f"CASE WHEN count(*) FILTER (WHERE {where[i]}) = 0 THEN 0.0 ELSE round(count(*) FILTER (WHERE ({where[i]}) "
        f"AND ({any_kid})) / CAST(count(*) FILTER (WHERE {where[i]}) AS DOUBLE), 4) END"
    )


def nodes(where: dict[str, str], extra=lambda i: "", children: dict[str, list[str]] = CHILDREN, id_name: str = "id", share: bool = True, size: bool = True) -> str:
    return union(
        f"SELECT '{i}' AS {id_name}{extra(i)}"
        + (f", count(*) FILTER (WHERE {w}) AS size" if size else "")
        + (f", {covered(i, where, children)} AS coverage" if share else "")
        + " FROM orders"
        for i, w in where.items()
    )


def named(names: dict[str, str]):
    return lambda i: f", '{names[i]}' AS name"


M = members()
PRICEY = members("o_totalprice >= 250000")
STALE = {
    **PRICEY,
    "c3": M["c3"],
    "c4": M["c4"],
    "c7": "o_totalprice >= 250000",
}
AFTER_DELETE = {i: M[i] for i in ("c0", "c2", "c3", "c4")}


def held(where: dict[str, str], label) -> str:
    return union(f"SELECT o_orderkey, '{label(i)}' AS x FROM orders WHERE {w}" for i, w in where.items())


# -- encoding -----------------------------------------------------------------


def z(expr: str) -> str:
    return f"round(coalesce(({expr} - avg({expr}) OVER ()) / stddev_samp({expr}) OVER (), 0), 4) + 0.0"


def z_cell(idx: int, name: str, expr: str) -> str:
    return (
        f"SELECT o_orderkey, CAST({idx} AS INTEGER) AS feature_idx, '{name}' AS feature_name, {z(expr)} AS x FROM orders"
    )


def hot_cells(first: int, column: str) -> str:
    return (
        f"SELECT o_orderkey, CAST({first} + i AS INTEGER) AS feature_idx, '{column}_' || v AS feature_name, "
        f"CASE WHEN {column} = v THEN 1.0 ELSE 0.0 END::DOUBLE AS x FROM orders CROSS JOIN (SELECT v, "
        f"row_number() OVER (ORDER BY v) - 1 AS i FROM (SELECT DISTINCT {column} AS v FROM orders WHERE {column} IS NOT NULL))"
    )


SECONDS = "CAST(floor(epoch_us(o_orderdate) / 1000000) AS DOUBLE)"
STATUSES = 3
ENCODED = union(
    [
        hot_cells(0, "o_orderstatus"),
        z_cell(STATUSES, "o_totalprice", "o_totalprice"),
        z_cell(STATUSES + 1, "o_orderdate", SECONDS),
        hot_cells(STATUSES + 2, "o_orderpriority"),
    ]
)


# -- training -----------------------------------------------------------------

WIDTH, SIDE, EPOCHS = 10, 5, 100


def hot_cell(column: str, i: int) -> str:
    value = f"(SELECT v FROM (SELECT DISTINCT {column} AS v FROM orders WHERE {column} IS NOT NULL) ORDER BY v LIMIT 1 OFFSET {i})"
    return f"coalesce(CAST({column} = {value} AS DOUBLE), 0.0)"


def scaled(expr: str) -> str:
    return f"coalesce(({expr} - avg({expr}) OVER ()) / stddev_samp({expr}) OVER (), 0.0)"


def each(cell: str) -> str:
    """A list with one sum per feature; ``{0}`` is the feature's place."""
    return "[" + ", ".join(f"sum({cell.format(j)})" for j in range(1, WIDTH + 1)) + "]"


ROW_CELLS = [
    *(hot_cell("o_orderstatus", i) for i in range(STATUSES)), scaled("o_totalprice"), scaled(SECONDS),
    *(hot_cell("o_orderpriority", i) for i in range(WIDTH - STATUSES - 2)),
]
ZEROS = "[" + ", ".join(["0.0::DOUBLE"] * WIDTH) + "]"
# One row per epoch: prototypes, feature weights, their moments, and the epoch's figures.
TRAINED = f"""
WITH RECURSIVE x AS MATERIALIZED (SELECT o_orderkey, [{', '.join(ROW_CELLS)}] AS v FROM orders),
start AS (
  SELECT list(v ORDER BY h, o_orderkey) AS book FROM (
    SELECT o_orderkey, v, md5(CAST(o_orderkey AS VARCHAR) || '|7') AS h FROM x ORDER BY h, o_orderkey LIMIT {SIDE * SIDE})),
near AS MATERIALIZED (
  SELECT e, list(row ORDER BY u) AS near FROM (
    SELECT e, u, list(exp(-((u // {SIDE} - w // {SIDE}) ** 2 + (u % {SIDE} - w % {SIDE}) ** 2) / (2 * r * r)) ORDER BY w) AS row
    FROM (SELECT e, greatest(0.5, {SIDE / 2} * (1.0 - e / {EPOCHS - 1}.0)) AS r FROM range({EPOCHS}) t(e)),
         range({SIDE * SIDE}) a(u), range({SIDE * SIDE}) b(w) GROUP BY e, u) GROUP BY e),
st AS (
  SELECT 0 AS e, list_transform(book, lambda p: list_transform(p, lambda a: a * 0.5)) AS proto, {ZEROS} AS w, {ZEROS} AS m1, {ZEROS} AS m2,
         0.0::DOUBLE AS dist, 0::BIGINT AS units, 0.0::DOUBLE AS loss FROM start
  UNION ALL
  SELECT * FROM (
    WITH g AS (
      SELECT st.*, list_transform(w, lambda a: 1.0 / (1.0 + exp(-a))) AS gate,
             list_transform(proto, lambda p: list_transform(p, lambda a:
               a / CASE WHEN list_dot_product(p, p) > 0 THEN sqrt(list_dot_product(p, p)) ELSE 1.0 END)) AS t
      FROM st WHERE e < {EPOCHS}),
    gated AS (SELECT v, list_transform(v, lambda a, j: a * gate[j]) AS raw, t FROM x, g),
    sized AS (SELECT v, t, sqrt(list_dot_product(raw, raw)) AS len, raw FROM gated),
    turned AS (SELECT v, t, len, CASE WHEN len > 0 THEN list_transform(raw, lambda a: a / len) ELSE raw END AS dir FROM sized),
    likened AS (SELECT *, list_transform(t, lambda p: list_dot_product(dir, p)) AS likes FROM turned),
    placed AS (SELECT v, t, len, dir, list_max(likes) AS cos, list_position(likes, list_max(likes)) AS u FROM likened),
    summed AS (SELECT u, count(*) AS c, {each('dir[{0}]')} AS total FROM placed GROUP BY u),
    whole AS (
      SELECT sum(1.0 - cos) AS away, count(*) AS rows,
             {each('CASE WHEN len > 0 THEN v[{0}] * (t[u][{0}] - cos * dir[{0}]) / len ELSE 0 END')} AS slope FROM placed),
    listed AS (SELECT list(c ORDER BY u) AS counts, list(u ORDER BY u) AS us, list(total ORDER BY u) AS totals FROM summed),
    massed AS (
      SELECT g.*, whole.*, listed.*, near,
             list_transform(near, lambda row: list_sum(list_transform(us, lambda a, i: row[a] * counts[i]))) AS mass
      FROM g, whole, listed, near WHERE near.e = g.e),
    moved AS (
      SELECT *, list_transform(proto, lambda old, u: CASE WHEN mass[u] > 1e-9 THEN list_transform(old, lambda a, j:
               list_sum(list_transform(us, lambda other, i: near[u][other] * totals[i][j])) / greatest(mass[u], 1e-12)) ELSE old END) AS pulled,
             list_transform(gate, lambda a, j: (-slope[j] / rows + 0.01) * a * (1.0 - a)) AS grad FROM massed),
    stepped AS (
      SELECT *, list_transform(m1, lambda a, j: 0.9 * a + 0.1 * grad[j]) AS n1,
             list_transform(m2, lambda a, j: 0.999 * a + 0.001 * grad[j] * grad[j]) AS n2 FROM moved)
    SELECT e + 1, pulled, list_transform(w, lambda a, j:
             a - 0.1 * (n1[j] / (1 - 0.9 ** (e + 1))) / (sqrt(n2[j] / (1 - 0.999 ** (e + 1))) + 1e-8)),
           n1, n2, away / rows, len(us)::BIGINT, away / rows + 0.01 * list_sum(gate) FROM stepped)),
model AS (SELECT proto, list_transform(w, lambda a: 1.0 / (1.0 + exp(-a))) AS gate FROM st WHERE e = {EPOCHS})
"""
# A row's direction is not needed: its length does not change which cosine is the highest.
SOM_5 = TRAINED + """
SELECT o_orderkey, CAST(list_position(likes, list_max(likes)) - 1 AS INTEGER) AS cluster FROM (
  SELECT o_orderkey, list_transform(proto, lambda p:
    list_dot_product(list_transform(v, lambda a, j: a * gate[j]), p) / sqrt(list_dot_product(p, p))) AS likes FROM x, model)
"""
SOM_6 = TRAINED + f"""
SELECT column_name, round(weight, 6) AS weight, weight = max(weight) OVER () AS best FROM (
  SELECT unnest(['o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) AS column_name,
         unnest([list_max(gate[1:{STATUSES}]), gate[{STATUSES + 1}], gate[{STATUSES + 2}], list_max(gate[{STATUSES + 3}:{WIDTH}])]) AS weight FROM model)
"""

# -- discovery ----------------------------------------------------------------

STEPS = ", ".join(f"{p / 100}" for p in range(5, 100, 5))
TENTHS = ", ".join(f"{p / 100}" for p in range(10, 100, 10))

SOM_7 = """
WITH c AS (SELECT CAST(o_orderkey % 5 AS INTEGER) AS cluster, o_orderpriority AS value, count(*) AS hits FROM orders
           WHERE o_orderpriority IS NOT NULL GROUP BY ALL),
     t AS (SELECT o_orderpriority AS value, count(*) AS support, min(o_orderkey) AS first_key FROM orders GROUP BY ALL),
     s AS (SELECT CAST(o_orderkey % 5 AS INTEGER) AS cluster, count(*) AS size FROM orders GROUP BY ALL),
     f AS (SELECT cluster, value, CAST(2 AS DOUBLE) * hits / (support + size) AS f1, support, hits, first_key
           FROM c JOIN t USING (value) JOIN s USING (cluster))
SELECT cluster, value, round(f1, 6) AS f1, support, hits FROM f
QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY f1 DESC, first_key) = 1
"""


def numeric_search(table: str, cluster: str, column: str) -> str:
    """CTEs ending in ``best``: the best bound or interval per cluster."""
    return f"""
WITH th AS (SELECT t, row_number() OVER (ORDER BY t) AS i FROM (SELECT DISTINCT round(t, 4) AS t FROM
            (SELECT unnest(quantile_cont(CAST({column} AS DOUBLE), [{STEPS}])) AS t FROM {table}))),
     cand AS (SELECT t AS low, CAST(NULL AS DOUBLE) AS high, 2 * i AS ord FROM th
              UNION ALL SELECT NULL, t, 2 * i + 1 FROM th
              UNION ALL SELECT a.t, b.t, 1000 + a.i * 100 + b.i FROM th a JOIN th b ON a.i < b.i),
     h AS (SELECT {cluster} AS cluster, {column} AS v, count(*) AS n FROM {table} GROUP BY ALL),
     size AS (SELECT cluster, sum(n) AS size FROM h GROUP BY ALL),
     hit AS (SELECT ord, low, high, cluster, sum(n) AS tp FROM cand JOIN h
             ON (low IS NULL OR v >= low) AND (high IS NULL OR v < high) GROUP BY ALL),
     sup AS (SELECT ord, sum(tp) AS support FROM hit GROUP BY ALL),
     f AS (SELECT cluster, low, high, ord, CAST(support AS BIGINT) AS support,
                  2.0::DOUBLE * CAST(tp AS DOUBLE) / CAST(support + size AS DOUBLE) AS f1
           FROM hit JOIN sup USING (ord) JOIN size USING (cluster)),
     best AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY f1 DESC, ord) = 1)
"""


SOM_8 = numeric_search("lineitem", "l_linenumber", "l_quantity") + (
    "SELECT CAST(cluster AS INTEGER) AS cluster, low, high, round(f1, 6) AS f1, support FROM best"
)

SOM_9 = f"""
WITH q AS (SELECT quantile_cont(CAST(epoch_us(l_shipdate) AS DOUBLE), [{TENTHS}]) AS qs FROM lineitem),
     th AS (SELECT floor(unnest(qs)) AS t, unnest(range(9)) AS i FROM q),
     cand AS (SELECT t, '>=' AS operator, 2 * i AS ord FROM th UNION ALL SELECT t, '<', 2 * i + 1 FROM th),
     h AS (SELECT l_linenumber AS cluster, epoch_us(l_shipdate) AS v, count(*) AS n FROM lineitem GROUP BY ALL),
     size AS (SELECT cluster, sum(n) AS size FROM h GROUP BY ALL),
     hit AS (SELECT ord, t, operator, cluster, sum(n) AS tp FROM cand JOIN h
             ON CASE WHEN operator = '>=' THEN v >= t ELSE v < t END GROUP BY ALL),
     sup AS (SELECT ord, sum(tp) AS support FROM hit GROUP BY ALL),
     f AS (SELECT cluster, t, operator, ord, CAST(support AS BIGINT) AS support,
                  2.0::DOUBLE * CAST(tp AS DOUBLE) / CAST(support + size AS DOUBLE) AS f1
           FROM hit JOIN sup USING (ord) JOIN size USING (cluster))
SELECT CAST(cluster AS INTEGER) AS cluster, operator, strftime(make_timestamp(CAST(t AS BIGINT)), '%Y-%m-%d') AS day,
       round(f1, 6) AS f1, support
FROM f QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY f1 DESC, ord) = 1
"""

BANDS = (
    "(SELECT CAST(least(floor(l_extendedprice / 12000), 7) * 2 + l_linenumber % 2 AS INTEGER) AS cluster, "
    "l_extendedprice FROM lineitem)"
)
DEDUPED = numeric_search(BANDS, "cluster", "l_extendedprice").rstrip() + """,
     kept AS (SELECT low, high, min(cluster) AS c0, arg_min(f1, cluster) AS f1, min(support) AS support
              FROM best GROUP BY low, high)
"""
NUMBERED = "CAST(row_number() OVER (ORDER BY c0) - 1 AS INTEGER) AS cluster, low, high, round(f1, 6) AS f1, support"
SOM_12 = DEDUPED + f"SELECT {NUMBERED} FROM kept"
SOM_13 = DEDUPED + f"""
SELECT {NUMBERED} FROM kept a WHERE NOT EXISTS (
    SELECT 1 FROM kept b WHERE b.support > a.support
      AND (b.low IS NULL OR (a.low IS NOT NULL AND b.low <= a.low))
      AND (b.high IS NULL OR (a.high IS NOT NULL AND b.high >= a.high)))
"""


# -- formal concepts ----------------------------------------------------------


def edges(expr: str) -> str:
    thirds = ", ".join(repr(i / 3) for i in range(4))
    return f"(SELECT quantile_cont(CAST({expr} AS DOUBLE), [{thirds}]) AS e FROM orders)"


def bin_of(expr: str, e: str = "e") -> str:
    return f"CASE WHEN {expr} < {e}[2] THEN 0 WHEN {expr} < {e}[3] THEN 1 ELSE 2 END"


def bins(expr: str, edge_sql: str, raw: str) -> str:
    return (
        f"SELECT CAST(bin AS INTEGER) AS bin, round(e[bin + 1], 4) AS lo, round(e[bin + 2], 4) AS hi, count(*) AS n_rows "
        f"FROM (SELECT e, {bin_of(expr)} AS bin FROM orders, {edge_sql} WHERE {raw} IS NOT NULL) GROUP BY ALL"
    )


EVEN = (
    "(SELECT [mn - (mx - mn) * 0.001, mn + (mx - mn) * 1 / 3, mn + (mx - mn) * 2 / 3, mx] AS e "
    "FROM (SELECT min(o_totalprice) AS mn, max(o_totalprice) AS mx FROM orders))"
)
CTX = (
    f"ctx AS (SELECT o_orderkey, o_orderstatus AS s, CAST({bin_of('o_totalprice', 'price.e')} AS VARCHAR) AS t, "
    f"CAST({bin_of(SECONDS, 'day.e')} AS VARCHAR) AS y, o_orderpriority AS p "
    f"FROM orders, {edges('o_totalprice')} price, {edges(SECONDS)} AS day)"
)
CODES = "styp"
ALONE = ", ".join(f"CASE WHEN count(DISTINCT {c}) = 1 AND count({c}) = count(*) THEN min({c}) END AS {c}" for c in CODES)
# A cell fixes some columns; its closure adds the columns that are constant in it.
CLOSED = f"""
WITH {CTX},
     cell AS (SELECT {ALONE}, count(*) AS size,
                     4 - (grouping(s) + grouping(t) + grouping(y) + grouping(p)) AS fixed
              FROM ctx GROUP BY CUBE (s, t, y, p)),
     con AS (SELECT s, t, y, p, size, min(fixed) AS depth FROM cell GROUP BY ALL),
     found AS (SELECT * FROM con WHERE depth <= 3)
"""
FIELDS = "s AS o_orderstatus, t AS o_totalprice, y AS o_orderdate, p AS o_orderpriority"
NAME = " || '/' || ".join(f"coalesce({{0}}.{c}, '*')" for c in CODES)


def wider(a: str, b: str) -> str:
    """Concept ``a`` fixes a proper part of what ``b`` fixes."""
    parts = " AND ".join(f"({a}.{c} IS NULL OR {a}.{c} IS NOT DISTINCT FROM {b}.{c})" for c in CODES)
    return f"({parts} AND {a}.size > {b}.size)"


def holds(con: str, row: str) -> str:
    return " AND ".join(f"({con}.{c} IS NULL OR {con}.{c} = {row}.{c})" for c in CODES)


# -- export -------------------------------------------------------------------


def _sql(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lexical(expr: str) -> str:
    return f"CAST({expr} AS VARCHAR)"


def local(expr: str) -> str:
    trimmed = f"regexp_replace(regexp_replace(regexp_replace({expr}, '[^\\w-]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g')"
    return f"CASE WHEN regexp_matches({trimmed}, '^[A-Za-z]') THEN {trimmed} ELSE 'x_' || {trimmed} END"


def triple(subject: str, p: str, o: str, kind: str, datatype: str | None, frm: str) -> str:
    dt = f"CAST({_sql(datatype) if datatype else 'NULL'} AS VARCHAR)"
    return f"SELECT {subject} AS s, {_sql(p)} AS p, {o} AS o, '{kind}' AS o_kind, {dt} AS o_datatype, CAST(NULL AS VARCHAR) AS o_lang FROM {frm}"


CUST = f"'{ENS}entity_' || c_custkey"
CUSTOMER_TRIPLES = union(
    [
        triple(CUST, RDF_TYPE, _sql(OWL + "NamedIndividual"), "uri", None, "customer"),
        triple(CUST, CNS + "c_custkey", "CAST(c_custkey AS VARCHAR)", "literal", XSD + "string", "customer"),
        triple(CUST, CNS + "c_name", "c_name", "literal", XSD + "string", "customer"),
        triple(CUST, CNS + "c_nationkey", "CAST(CAST(c_nationkey AS DOUBLE) AS VARCHAR)", "literal", XSD + "decimal", "customer"),
        triple(CUST, CNS + "c_acctbal", lexical("c_acctbal"), "literal", XSD + "decimal", "customer"),
        triple(CUST, CNS + "c_mktsegment", f"'{CNS}c_mktsegment_' || {local('c_mktsegment')}", "uri", None, "customer"),
    ]
)
ORDER = f"'{ENS}entity_' || o_orderkey"
ORDER_TRIPLES = union(
    [
        triple(ORDER, CNS + "o_orderkey", "CAST(o_orderkey AS VARCHAR)", "literal", XSD + "string", "orders"),
        triple(ORDER, CNS + "o_custkey", "CAST(CAST(o_custkey AS DOUBLE) AS VARCHAR)", "literal", XSD + "decimal", "orders"),
        triple(ORDER, CNS + "o_orderstatus", f"'{CNS}o_orderstatus_' || {local('o_orderstatus')}", "uri", None, "orders"),
        triple(ORDER, CNS + "o_totalprice", lexical("o_totalprice"), "literal", XSD + "decimal", "orders"),
        triple(ORDER, CNS + "o_orderdate", "strftime(o_orderdate, '%Y-%m-%d')", "literal", XSD + "date", "orders"),
        triple(ORDER, CNS + "o_orderpriority", f"'{CNS}o_orderpriority_' || {local('o_orderpriority')}", "uri", None, "orders"),
    ]
)
LINE = (
    "CASE WHEN starts_with(s, '_:') THEN s ELSE '<' || s || '>' END || ' <' || p || '> ' || "
    "CASE WHEN o_kind = 'uri' THEN '<' || o || '>' ELSE '\"' || o || '\"' || coalesce('^^<' || o_datatype || '>', '') END || ' .'"
)
TURTLE = (
    f"SELECT '{ENS}entity_' || c_custkey AS s, 'ent:entity_' || c_custkey || ' a owl:NamedIndividual ;\n    :c_acctbal \"' || "
    f"{lexical('c_acctbal')} || '\"^^xsd:decimal ;\n    :c_custkey \"' || c_custkey || '\"^^xsd:string ;\n    :c_mktsegment :c_mktsegment_' || "
    f"{local('c_mktsegment')} || ' ;\n    :c_name \"' || c_name || '\"^^xsd:string ;\n    :c_nationkey \"' || "
    f"CAST(CAST(c_nationkey AS DOUBLE) AS VARCHAR) || '\"^^xsd:decimal .\n' AS block_text FROM customer"
)


NUMBERED_CONCEPTS = (
    "SELECT *, (s IS NOT NULL)::INT + (t IS NOT NULL)::INT + (y IS NOT NULL)::INT + (p IS NOT NULL)::INT AS m, "
    "CASE WHEN seq = 0 THEN 'root' WHEN seq < 10 THEN 'c0' || seq ELSE 'c' || seq END AS id FROM ("
    "SELECT *, row_number() OVER (ORDER BY depth, size DESC, "
    + ", ".join(f"{c} NULLS FIRST" for c in CODES)
    + ") - 1 AS seq FROM found)"
)


def _part(c: str, before: str, column: str, value: str, lo: str, hi: str, last: str, datatype: str) -> str:
    return (
        f"SELECT id, m, {before} AS i, '{CNS}{column}' AS prop, {value} AS value, {lo} AS lo, {hi} AS hi, {last} AS closed, "
        f"CAST({datatype} AS VARCHAR) AS dt FROM named, {edges('o_totalprice')} price, {edges(SECONDS)} AS day WHERE {c} IS NOT NULL"
    )


def _held(columns: str) -> str:
    return " + ".join(["0", *(f"({c} IS NOT NULL)::INT" for c in columns)])


def _category(c: str, before: str, column: str) -> str:
    return _part(c, before, column, f"'{CNS}{column}_' || {local(c)}", "NULL", "NULL", "false", "NULL")


def _range(c: str, before: str, column: str, bound: str, datatype: str) -> str:
    return _part(
        c, before, column, "NULL", bound.format(f"CAST({c} AS INTEGER) + 1"), bound.format(f"CAST({c} AS INTEGER) + 2"),
        f"{c} = '2'", _sql(datatype),
    )


def _axiom(s: str, p: str, o: str, kind: str, where: str, dt: str = "NULL") -> str:
    return f"SELECT {s} AS s, {p} AS p, {o} AS o, '{kind}' AS o_kind, CAST({dt} AS VARCHAR) AS o_datatype, CAST(NULL AS VARCHAR) AS o_lang FROM part WHERE {where}"


def _node(kind: str, i: str | None = None) -> str:
    return f"'_:' || id || '_{kind}'" + (f" || ({i})" if i else "")


PARTS = union(
    [
        _category("s", _held(""), "o_orderstatus"),
        _range("t", _held("s"), "o_totalprice", "CAST(price.e[{0}] AS VARCHAR)", XSD + "decimal"),
        _range("y", _held("st"), "o_orderdate", "strftime(make_timestamp(CAST(floor(day.e[{0}]) AS BIGINT) * 1000000), '%Y-%m-%d')", XSD + "date"),
        _category("p", _held("sty"), "o_orderpriority"),
    ]
)
_WHOLE = f"CASE WHEN m > 1 THEN {_node('x')} ELSE {_node('r', 'i')} END"
LATTICE_AXIOMS = f"{CLOSED}, named AS ({NUMBERED_CONCEPTS}), part AS ({PARTS})" + union(
    [
        _axiom(f"'{CNS}' || id", _sql(OWL + "equivalentClass"), _WHOLE, "blank", "i = 0"),
        _axiom(_node("x"), _sql(RDF_TYPE), _sql(OWL + "Class"), "uri", "i = 0 AND m > 1"),
        _axiom(_node("x"), _sql(OWL + "intersectionOf"), _node("l", "i"), "blank", "i = 0 AND m > 1"),
        _axiom(_node("l", "i"), _sql(RDF + "first"), _node("r", "i"), "blank", "m > 1"),
        _axiom(_node("l", "i"), _sql(RDF + "rest"), _node("l", "i + 1"), "blank", "m > 1 AND i < m - 1"),
        _axiom(_node("l", "i"), _sql(RDF + "rest"), _sql(RDF + "nil"), "uri", "m > 1 AND i = m - 1"),
        _axiom(_node("r", "i"), _sql(RDF_TYPE), _sql(OWL + "Restriction"), "uri", "true"),
        _axiom(_node("r", "i"), _sql(OWL + "onProperty"), "prop", "uri", "true"),
        _axiom(_node("r", "i"), _sql(OWL + "hasValue"), "value", "uri", "value IS NOT NULL"),
        _axiom(_node("r", "i"), _sql(OWL + "someValuesFrom"), _node("d", "i"), "blank", "value IS NULL"),
        _axiom(_node("d", "i"), _sql(RDF_TYPE), _sql(RDFS + "Datatype"), "uri", "value IS NULL"),
        _axiom(_node("d", "i"), _sql(OWL + "onDatatype"), "dt", "uri", "value IS NULL"),
        _axiom(_node("d", "i"), _sql(OWL + "withRestrictions"), _node("f", "i"), "blank", "value IS NULL"),
        _axiom(_node("f", "i"), _sql(RDF + "first"), _node("lo", "i"), "blank", "value IS NULL"),
        _axiom(_node("f", "i"), _sql(RDF + "rest"), _node("g", "i"), "blank", "value IS NULL"),
        _axiom(_node("g", "i"), _sql(RDF + "first"), _node("hi", "i"), "blank", "value IS NULL"),
        _axiom(_node("g", "i"), _sql(RDF + "rest"), _sql(RDF + "nil"), "uri", "value IS NULL"),
        _axiom(_node("lo", "i"), _sql(XSD + "minInclusive"), "lo", "literal", "value IS NULL", "dt"),
        _axiom(
            _node("hi", "i"), f"CASE WHEN closed THEN '{XSD}maxInclusive' ELSE '{XSD}maxExclusive' END", "hi", "literal", "value IS NULL", "dt"
        ),
    ]
)


def uri(i: str) -> str:
    return CNS + LOCAL[i]


def values(rows: list[tuple], names: list[str]) -> str:
    """Given triples. They restate definitions, so each is tied to a table that has rows."""
    body = ", ".join("(" + ", ".join("NULL" if v is None else _sql(v) for v in r) + ")" for r in rows)
    return f"SELECT {', '.join(names)} FROM (VALUES {body}) v({', '.join(names)}) WHERE EXISTS (SELECT 1 FROM orders)"


SPO = ["s", "p", "o"]
SPOD = ["s", "p", "o", "o_datatype"]


def _list(c: str, first: int, items: list[str]) -> list[tuple]:
    out = []
    for k, item in enumerate(items):
        node = f"_:{c}_{first + k}"
        rest = f"_:{c}_{first + k + 1}" if k + 1 < len(items) else RDF + "nil"
        out += [(node, RDF + "first", item, None), (node, RDF + "rest", rest, None)]
    return out


def _class(node: str, p: str, o: str) -> list[tuple]:
    return [(node, RDF_TYPE, OWL + "Class", None), (node, p, o, None)]


def _restriction(node: str, column: str, p: str, o: str) -> list[tuple]:
    return [
        (node, RDF_TYPE, OWL + "Restriction", None),
        (node, OWL + "onProperty", CNS + column, None),
        (node, p, o, None),
    ]


def _ranged(c: str, n: int, column: str, facet: str, value: str, base: str) -> list[tuple]:
    """Blank nodes n (facet), n+1 (datatype), n+2 (facet list), n+3 (restriction)."""
    return [
        (f"_:{c}_{n}", XSD + facet, value, XSD + base),
        (f"_:{c}_{n + 1}", RDF_TYPE, RDFS + "Datatype", None),
        (f"_:{c}_{n + 1}", OWL + "onDatatype", XSD + base, None),
        (f"_:{c}_{n + 1}", OWL + "withRestrictions", f"_:{c}_{n + 2}", None),
        *_list(c, n + 2, [f"_:{c}_{n}"]),
        *_restriction(f"_:{c}_{n + 3}", column, OWL + "someValuesFrom", f"_:{c}_{n + 1}"),
    ]


def _same(c: str, node: int) -> tuple:
    return (uri(c), OWL + "equivalentClass", f"_:{c}_{node}", None)


INTERSECTION, UNION_OF, COMPLEMENT = OWL + "intersectionOf", OWL + "unionOf", OWL + "complementOf"
RDF_7_ROWS = [
    *_ranged("c1", 1, "o_totalprice", "minInclusive", "300000.0", "decimal"),
    *_list("c1", 5, [uri("c0"), "_:c1_4"]),
    *_class("_:c1_7", INTERSECTION, "_:c1_5"),
    _same("c1", 7),
]
RDF_8_ROWS = [
    *_list("c3", 1, [uri("c1"), uri("c2")]),
    *_class("_:c3_3", UNION_OF, "_:c3_1"),
    *_class("_:c3_4", COMPLEMENT, "_:c3_3"),
    *_list("c3", 5, [uri("c0"), "_:c3_4"]),
    *_class("_:c3_7", INTERSECTION, "_:c3_5"),
    _same("c3", 7),
    *_class("_:c7_1", COMPLEMENT, uri("c6")),
    *_list("c7", 2, [uri("c1"), "_:c7_1"]),
    *_class("_:c7_4", INTERSECTION, "_:c7_2"),
    _same("c7", 4),
]
RDF_9_ROWS = [
    *_list("c4", 1, [uri("c1"), uri("c2")]),
    *_class("_:c4_3", UNION_OF, "_:c4_1"),
    _same("c4", 3),
    *_list("c5", 1, [uri("c1"), uri("c2")]),
    *_class("_:c5_3", INTERSECTION, "_:c5_1"),
    _same("c5", 3),
]
RDF_10_ROWS = [
    *_restriction("_:c2_1", "o_orderpriority", OWL + "hasValue", CNS + "o_orderpriority_x_1-URGENT"),
    *_list("c2", 2, [uri("c0"), "_:c2_1"]),
    *_class("_:c2_4", INTERSECTION, "_:c2_2"),
    _same("c2", 4),
    *_ranged("c6", 1, "o_orderdate", "minInclusive", "1997-01-01", "date"),
    *_restriction("_:c6_5", "o_orderstatus", OWL + "hasValue", CNS + "o_orderstatus_F"),
    *_list("c6", 6, [uri("c1"), "_:c6_4", "_:c6_5"]),
    *_class("_:c6_9", INTERSECTION, "_:c6_6"),
    _same("c6", 9),
]

CLASS_ROWS = []
for _i in M:
    CLASS_ROWS.append((uri(_i), RDF_TYPE, OWL + "Class", _i))
    if NAMES[_i]:
        CLASS_ROWS.append((uri(_i), RDFS + "label", NAMES[_i], _i))
    for _p in filter(None, PARENTS[_i].split(",")):
        CLASS_ROWS.append((uri(_i), RDFS + "subClassOf", uri(_p), _i))
CLASS_ROWS.append((uri("c0"), RDFS + "subClassOf", OWL + "Thing", "c0"))


def property_rows(table: str) -> str:
    """Properties of detected columns."""
    parts = []
    for column in COLUMNS[table]:
        c = column.rstrip("$@")
        kind = f"(SELECT {detected(column)} FROM {table})"
        parts.append(
            f"SELECT '{CNS}{c}' AS s, {_sql(RDF_TYPE)} AS p, CASE WHEN {kind} = 'categorical' THEN {_sql(OWL + 'ObjectProperty')} "
            f"ELSE {_sql(OWL + 'DatatypeProperty')} END AS o"
        )
        parts.append(
            f"SELECT * FROM (SELECT '{CNS}{c}' AS s, {_sql(RDFS + 'range')} AS p, CASE {kind} WHEN 'numeric' THEN {_sql(XSD + 'decimal')} "
            f"WHEN 'date' THEN {_sql(XSD + 'date')} WHEN 'title_id' THEN {_sql(XSD + 'string')} END AS o) WHERE o IS NOT NULL"
        )
    return union(parts)


def value_rows(column: str) -> str:
    u = f"'{CNS}{column}_' || {local(column)}"
    return union(
        [
            f"SELECT DISTINCT {u} AS s, {_sql(RDF_TYPE)} AS p, {_sql(OWL + 'NamedIndividual')} AS o, 'uri' AS o_kind FROM orders WHERE {column} IS NOT NULL",
            f"SELECT DISTINCT {u} AS s, {_sql(RDFS + 'label')} AS p, {column} AS o, 'literal' AS o_kind FROM orders WHERE {column} IS NOT NULL",
        ]
    )


INDIVIDUALS = union(
    [
        f"SELECT {ORDER} AS individual FROM orders",
        f"SELECT DISTINCT '{CNS}o_orderstatus_' || {local('o_orderstatus')} FROM orders WHERE o_orderstatus IS NOT NULL",
        f"SELECT DISTINCT '{CNS}o_orderpriority_' || {local('o_orderpriority')} FROM orders WHERE o_orderpriority IS NOT NULL",
    ]
)
EDGES = union(
    f"SELECT '{uri(p)}' AS parent, '{uri(i)}' AS child" for i in M for p in filter(None, PARENTS[i].split(","))
)
CLASSES = union(f"SELECT '{uri(i)}' AS class" for i in M)
INSTANCES = union(f"SELECT '{uri(i)}' AS class, count(*) FILTER (WHERE {w}) AS n FROM orders" for i, w in M.items())
DEPTHS = f"""
SELECT class, CAST(max(d) AS INTEGER) AS depth FROM (
WITH RECURSIVE e AS ({EDGES}), walk(class, d) AS (
    SELECT class, 0 FROM ({CLASSES}) WHERE class NOT IN (SELECT child FROM e)
    UNION ALL SELECT e.child, d + 1 FROM walk JOIN e ON walk.class = e.parent)
SELECT class, d FROM walk) GROUP BY class
"""
LEAVES = f"SELECT class FROM ({CLASSES}) WHERE class NOT IN (SELECT parent FROM ({EDGES}))"
BRANCHES = f"SELECT parent AS class, count(*) AS n_children FROM ({EDGES}) GROUP BY parent"
BELOW_ROOT = " OR ".join(f"({w})" for i, w in M.items() if i != "c0")
N_AND_COVERAGE = (
    f"SELECT count(*) AS n_individuals, round((SELECT count(*) FROM orders WHERE {BELOW_ROOT}) / CAST(count(*) AS DOUBLE), 4) "
    f"AS coverage FROM ({INDIVIDUALS})"
)


def spread(frm: str, column: str, name: str) -> str:
    return (
        f"(SELECT round(avg({column}), 3) FROM ({frm})) AS avg_{name}, "
        f"(SELECT round(coalesce(stddev_samp({column}), 0), 3) FROM ({frm})) AS std_{name}"
    )


LEAF_INSTANCES = f"SELECT n FROM ({INSTANCES}) WHERE class IN ({LEAVES})"
ORDER_STATS = f"""
SELECT 'orders' AS file, (SELECT count(*) FROM ({CLASSES})) AS n_classes, n_individuals,
  2::BIGINT AS n_object_properties, 4::BIGINT AS n_datatype_properties, 4::BIGINT AS n_restrictions, 7::BIGINT AS n_equiv_class,
  (SELECT CAST(max(depth) + 1 AS BIGINT) FROM ({DEPTHS})) AS n_levels, 1::BIGINT AS n_roots,
  (SELECT count(*) FROM ({LEAVES})) AS n_leaves,
  (SELECT count(*) FROM (SELECT child FROM ({EDGES}) GROUP BY child HAVING count(*) > 1)) AS n_multi_parent,
  {spread(DEPTHS, 'depth', 'depth')}, {spread(BRANCHES, 'n_children', 'branching')}, {spread(INSTANCES, 'n', 'inst')},
  (SELECT round(median(CAST(n AS DOUBLE)), 3) FROM ({INSTANCES})) AS med_inst, {spread(LEAF_INSTANCES, 'n', 'leaf_inst')},
  (SELECT round(median(CAST(n AS DOUBLE)), 3) FROM ({LEAF_INSTANCES})) AS med_leaf_inst,
  (SELECT count(*) FROM ({INSTANCES}) WHERE n = 0) AS n_empty_classes, coverage
FROM ({N_AND_COVERAGE})
"""
CUSTOMER_STATS = """
SELECT 'customers' AS file, 1::BIGINT AS n_classes, (SELECT count(*) + count(DISTINCT c_mktsegment) FROM customer) AS n_individuals,
  1::BIGINT AS n_object_properties, 4::BIGINT AS n_datatype_properties, 0::BIGINT AS n_restrictions, 0::BIGINT AS n_equiv_class,
  1::BIGINT AS n_levels, 1::BIGINT AS n_roots, 1::BIGINT AS n_leaves, 0::BIGINT AS n_multi_parent,
  0.0::DOUBLE AS avg_depth, 0.0::DOUBLE AS std_depth, 0.0::DOUBLE AS avg_branching, 0.0::DOUBLE AS std_branching,
  count(*)::DOUBLE AS avg_inst, 0.0::DOUBLE AS std_inst, count(*)::DOUBLE AS med_inst,
  count(*)::DOUBLE AS avg_leaf_inst, 0.0::DOUBLE AS std_leaf_inst, count(*)::DOUBLE AS med_leaf_inst,
  0::BIGINT AS n_empty_classes, 0.0::DOUBLE AS coverage FROM customer
"""

LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def stat_row(extra: str, table: str, where: str, column: str, kind: str, k: int = 5) -> str:
    null_num = ", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in ("mean", "std", "lo", "hi"))
    null_date = ", ".join(f"CAST(NULL AS VARCHAR) AS {c}" for c in ("mean_date", "min_date", "max_date"))
    head = f"SELECT {extra}'{column}' AS column_name, '{kind}' AS kind"
    if kind == "numeric":
        body = (
            f"round(avg({column}), 4) AS mean, round(stddev_samp({column}), 4) AS std, round(CAST(min({column}) AS DOUBLE), 4) AS lo, "
            f"round(CAST(max({column}) AS DOUBLE), 4) AS hi, {null_date}, CAST(NULL AS VARCHAR) AS top_text FROM {table} {where} HAVING count(*) > 0"
        )
    elif kind == "date":
        body = (
            f"{null_num}, strftime(make_timestamp(CAST(floor(avg(epoch_us({column}))) AS BIGINT)), '%Y-%m-%d') AS mean_date, "
            f"strftime(min({column}), '%Y-%m-%d') AS min_date, strftime(max({column}), '%Y-%m-%d') AS max_date, "
            f"CAST(NULL AS VARCHAR) AS top_text FROM {table} {where} HAVING count(*) > 0"
        )
    else:
        body = f"{null_num}, {null_date}, t AS top_text FROM (SELECT {top_text(table, column, k, where)} AS t) WHERE t IS NOT NULL"
    return f"{head}, {body}"


LINE_KINDS = {
    "l_linenumber": "numeric", "l_quantity": "numeric", "l_extendedprice": "numeric", "l_discount": "numeric",
    "l_tax": "numeric", "l_returnflag": "categorical", "l_linestatus": "categorical", "l_shipdate": "date",
}
ORDER_KINDS = {
    "o_orderstatus": "categorical", "o_totalprice": "numeric", "o_orderdate": "date", "o_orderpriority": "categorical",
}


def summary_row(i: int, column: str, kind: str) -> str:
    null = {
        "num": ", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in ("mean", "median", "std", "lo", "hi")),
        "date": "CAST(NULL AS VARCHAR) AS min_date, CAST(NULL AS VARCHAR) AS max_date, CAST(NULL AS BIGINT) AS range_days",
        "text": "CAST(NULL AS BIGINT) AS n_unique, CAST(NULL AS VARCHAR) AS top_text, CAST(NULL AS VARCHAR) AS samples",
    }
    head = (
        f"SELECT '{column}' AS column_name, CAST({i} AS INTEGER) AS ordinal, '{kind}' AS kind, count({column}) AS n, "
        f"count(*) - count({column}) AS missing"
    )
    if kind == "numeric":
        body = (
            f"round(avg({column}), 4) AS mean, round(median(CAST({column} AS DOUBLE)), 4) AS median, round(stddev_samp({column}), 4) AS std, "
            f"round(CAST(min({column}) AS DOUBLE), 4) AS lo, round(CAST(max({column}) AS DOUBLE), 4) AS hi, {null['date']}, {null['text']}"
        )
    elif kind == "date":
        body = (
            f"{null['num']}, strftime(min({column}), '%Y-%m-%d') AS min_date, strftime(max({column}), '%Y-%m-%d') AS max_date, "
            f"CAST(floor((epoch_us(max({column})) - epoch_us(min({column}))) / 86400000000) AS BIGINT) AS range_days, {null['text']}"
        )
    elif kind == "categorical":
        body = (
            f"{null['num']}, {null['date']}, count(DISTINCT {column}) AS n_unique, {top_text('orders', column, 10)} AS top_text, "
            f"CAST(NULL AS VARCHAR) AS samples"
        )
    else:
        body = (
            f"{null['num']}, {null['date']}, count(DISTINCT {column}) AS n_unique, CAST(NULL AS VARCHAR) AS top_text, "
            f"(SELECT string_agg(v, '|' ORDER BY k) FROM (SELECT CAST({column} AS VARCHAR) AS v, o_orderkey AS k FROM orders "
            f"WHERE {column} IS NOT NULL ORDER BY o_orderkey LIMIT 5)) AS samples"
        )
    return f"{head}, {body} FROM orders"


def domain(column: str, kind: str) -> str:
    null_num = ", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in ("lo", "hi", "mean", "median"))
    null_date = "CAST(NULL AS VARCHAR) AS min_date, CAST(NULL AS VARCHAR) AS max_date"
    head = f"SELECT '{column}' AS column_name, '{kind}' AS kind"
    if kind == "categorical":
        return (
            f"{head}, '=' AS operators, v AS value, {null_num}, {null_date} FROM (SELECT {column} AS v, count(*) OVER () AS k "
            f"FROM orders WHERE {A} AND {column} IS NOT NULL GROUP BY {column}) WHERE k > 1"
        )
    ops = "'= > >= < <=' AS operators, CAST(NULL AS VARCHAR) AS value"
    if kind == "numeric":
        return (
            f"{head}, {ops}, round(min({column}), 4) AS lo, round(max({column}), 4) AS hi, round(avg({column}), 4) AS mean, "
            f"round(median({column}), 4) AS median, {null_date} FROM orders WHERE {A} HAVING count(DISTINCT {column}) > 1"
        )
    return (
        f"{head}, {ops}, {null_num}, strftime(min({column}), '%Y-%m-%d') AS min_date, strftime(max({column}), '%Y-%m-%d') AS max_date "
        f"FROM orders WHERE {A} HAVING count(DISTINCT {column}) > 1"
    )


MATCHES = [("=", "="), (">", ">"), (">=", ">="), ("<", "<"), ("<=", "<=")]
PARTS = {
    "a": "l_quantity >= 1 AND l_quantity < 20",
    "b": "l_quantity >= 10 AND l_quantity < 30",
    "c": "l_quantity >= 30 AND l_quantity < 60",
    "d": "l_returnflag = 'R'",
}


def leaf_types() -> str:
    """Classes of a row without a child class that also holds it."""
    parts = []
    for i, w in M.items():
        kids = "".join(f" AND NOT ({M[k]})" for k in CHILDREN.get(i, []))
        parts.append(f"SELECT o_orderkey, '{uri(i)}' AS o FROM orders WHERE ({w}){kids}")
    return union(parts)


ORACLE: dict[str, str] = {
    "src_1": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders",
    "src_2": "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer",
    "src_3": "SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part",
    "src_4": union(
        f"SELECT '{t}' AS table_name, '{f}' AS format, {r} AND count(*) > 0 AS readable FROM {t}"
        for t in COLUMNS
        for f, r in (("parquet", "true"), ("xlsx", "false"))
    ),
    "src_5": "SELECT * FROM supplier",
    "src_6": "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_id, c_custkey, c_custkey AS key_id FROM customer",
    "src_7": (
        "SELECT column_name, ordinal, CASE WHEN column_name = 'o_custkey' THEN 'numeric' ELSE detected_type END AS user_type, "
        f"column_name = 'o_custkey' OR detected_type <> 'title_id' AS include FROM ({types('orders')})"
    ),
    "src_8": CUSTOMER_TRIPLES,
    "snk_1": f"SELECT {LINE} AS line FROM ({CUSTOMER_TRIPLES})",
    "snk_2": TURTLE,
    "snk_3": f"SELECT file, n_classes, n_individuals, n_leaves, coverage FROM ({ORDER_STATS})",
    "snk_4": nodes(M, lambda i: f", count(*) FILTER (WHERE {M[i]}) AS n_rows", id_name="concept_id", share=False),
    "typ_1": union(f"SELECT *, detected_type <> 'title_id' AS include FROM ({types(t)})" for t in COLUMNS),
    "typ_2": (
        "SELECT column_name, detected_type, CASE WHEN column_name = 'p_size' THEN 'categorical' ELSE detected_type END AS user_type, "
        f"column_name <> 'p_retailprice' AND detected_type <> 'title_id' AS include FROM ({types('part')})"
    ),
    "typ_3": (
        f"SELECT column_name, detected_type AS user_type FROM ({types('customer')}) "
        "WHERE detected_type <> 'title_id' AND column_name <> 'c_custkey'"
    ),
    "sum_1": union(numbers("lineitem", c) for c in LINE_NUMBERS),
    "sum_2": union([days("orders", "o_orderdate"), days("lineitem", "l_shipdate"), days("events", "ts")]),
    "sum_3": (
        "SELECT 'c_name' AS column_name, count(c_name) AS n, count(*) - count(c_name) AS missing, count(DISTINCT c_name) AS n_unique, "
        "(SELECT string_agg(c_name, '|' ORDER BY c_custkey) FROM (SELECT * FROM customer WHERE c_name IS NOT NULL ORDER BY c_custkey LIMIT 5)) "
        "AS samples FROM customer"
    ),
    "sum_4": union(top("part", c) for c in ("p_brand", "p_type", "p_name")),
    "sum_5": union(
        summary_row(i, c, k)
        for i, (c, k) in enumerate(
            [("o_orderkey", "title_id"), ("o_custkey", "numeric"), *list(ORDER_KINDS.items())]
        )
    ),
    "sum_7": union(stat_row("", "lineitem", "WHERE l_quantity >= 25", c, k) for c, k in LINE_KINDS.items()),
    "sum_7_all": union(
        stat_row(f"'{i}' AS concept_id, ", "orders", f"WHERE {w}", c, k) for i, w in M.items() for c, k in ORDER_KINDS.items()
    ),
    "sum_8": union(domain(c, k) for c, k in ORDER_KINDS.items()),
    "enc_1": z_cell(0, "o_totalprice", "o_totalprice"),
    "enc_2": z_cell(0, "o_orderdate", SECONDS),
    "enc_3": hot_cells(0, "o_orderpriority"),
    "enc_3_long": """
        WITH f AS (SELECT *, row_number() OVER (ORDER BY ordinal, value) - 1 AS feature_idx FROM (
                SELECT 1 AS ordinal, 'c_name' AS col, c_name AS value FROM customer GROUP BY ALL
                UNION ALL SELECT 2, 'c_nationkey', NULL UNION ALL SELECT 3, 'c_acctbal', NULL
                UNION ALL SELECT 4, 'c_mktsegment', c_mktsegment FROM customer GROUP BY ALL) ),
             cell AS (SELECT c_custkey, 'c_name' AS col, c_name AS value, 1.0::DOUBLE AS x FROM customer
                UNION ALL SELECT c_custkey, 'c_mktsegment', c_mktsegment, 1.0 FROM customer
                UNION ALL SELECT c_custkey, 'c_nationkey', NULL, (c_nationkey - avg(c_nationkey) OVER ()) / stddev_samp(c_nationkey) OVER () FROM customer
                UNION ALL SELECT c_custkey, 'c_acctbal', NULL, (c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER () FROM customer)
        SELECT c_custkey, feature_idx, CASE WHEN f.value IS NULL THEN f.col ELSE f.col || '_' || f.value END AS feature_name,
               round(x, 4) + 0.0 AS x
        FROM cell JOIN f ON cell.col = f.col AND cell.value IS NOT DISTINCT FROM f.value WHERE x <> 0
    """,
    "enc_4": ENCODED,
    "enc_5": union([hot_cells(0, "o_orderstatus"), z_cell(STATUSES, "o_totalprice", "o_totalprice")]),
    "prd_1": f"SELECT o_orderkey, o_orderpriority FROM orders WHERE {B}",
    "prd_2": union(
        f"SELECT '{o}' AS operator, count(*) FILTER (WHERE l_quantity {s} 25) AS n FROM lineitem" for o, s in MATCHES
    ),
    "prd_3": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-30'",
    "prd_4": (
        "SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE l_quantity > 10 AND l_discount <= 0.05::DOUBLE "
        "AND l_returnflag = 'A' AND l_shipdate >= TIMESTAMP '1998-01-01'"
    ),
    "prd_5": (
        "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_extendedprice >= 20000 AND l_extendedprice < 30000"
    ),
    "con_1": "SELECT o_orderkey FROM orders",
    "con_2": f"SELECT o_orderkey FROM orders WHERE {A} INTERSECT SELECT o_orderkey FROM orders WHERE {L}",
    "con_3": f"SELECT o_orderkey FROM orders EXCEPT (SELECT o_orderkey FROM orders WHERE {A} UNION SELECT o_orderkey FROM orders WHERE {B})",
    "con_4": f"SELECT o_orderkey FROM orders WHERE {A} UNION SELECT o_orderkey FROM orders WHERE {B}",
    "con_5": f"SELECT o_orderkey FROM orders WHERE {A} INTERSECT SELECT o_orderkey FROM orders WHERE {B}",
    "con_6": "SELECT * FROM ("
    + union(
        f"SELECT '{a}{b}' AS pair, count(*) FILTER (WHERE ({PARTS[a]}) AND ({PARTS[b]})) AS size FROM lineitem"
        for a in PARTS
        for b in PARTS
        if a < b
    )
    + ") WHERE size > 0",
    "con_7": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 5 AND l_quantity < 30",
    "con_8": nodes(PRICEY, named({**NAMES, "c1": "Pricey"})),
    "con_8_snapshot": nodes(STALE, named({**NAMES, "c1": "Pricey"})),
    "con_9": nodes(AFTER_DELETE),
    "con_10": nodes({"c0": "true"}, named(NAMES), {}),
    "con_11": f"SELECT x AS concept_id, o_orderkey FROM ({held(M, lambda i: i)})",
    "con_12": nodes(M, id_name="concept_id", share=False),
    "con_13": nodes(M, id_name="concept_id", size=False),
    "con_14": nodes(
        M,
        lambda i: f", '{NAMES[i]}' AS name, '{ORIGIN[i]}' AS origin, '{PARENTS[i]}' AS parents, '{','.join(CHILDREN.get(i, []))}' AS children",
    ),
    "con_14_edges": union(
        f"SELECT '{p}' AS parent_id, '{c}' AS child_id, CAST({n} AS INTEGER) AS ord, count(*) FILTER (WHERE {M[c]}) AS size FROM orders"
        for p, cs in CHILDREN.items()
        for n, c in enumerate(cs)
    ),
    "con_17": nodes(M, lambda i: f", CAST({i[1:]} AS INTEGER) AS seq", share=False),
    "som_2": f"""
        SELECT CAST(unit AS INTEGER) AS unit, feature_idx, x FROM ({ENCODED}) JOIN (
            SELECT o_orderkey, row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|7'), o_orderkey) - 1 AS unit
            FROM orders) USING (o_orderkey) WHERE unit < 25
    """,
    "som_1": """
        SELECT CAST(map_size AS INTEGER) AS map_size, CAST(epochs AS INTEGER) AS epochs,
               map_size BETWEEN 2 AND 20 AND epochs BETWEEN 5 AND 5000 AS accepted,
               CAST((SELECT greatest(5, least(5000, floor(250000.0 / count(*) + 0.5))) FROM orders) AS INTEGER) AS suggested
        FROM (VALUES (1, 20), (2, 5), (20, 5000), (21, 20), (5, 4), (5, 5001)) v(map_size, epochs)
    """,
    "som_3": TRAINED
    + "SELECT CAST(u - 1 AS INTEGER) AS unit, CAST(j - 1 AS INTEGER) AS feature_idx, round(proto[u][j], 6) + 0.0 AS x "
    f"FROM model, range(1, {SIDE * SIDE + 1}) a(u), range(1, {WIDTH + 1}) b(j)",
    "som_4": TRAINED
    + "SELECT CAST(e AS INTEGER) AS epoch, round(dist, 6) AS dist, CAST(units AS INTEGER) AS units, round(loss, 6) AS loss FROM st WHERE e > 0",
    "som_5": SOM_5,
    "som_6": SOM_6,
    "som_7": SOM_7,
    "som_8": SOM_8,
    "som_9": SOM_9,
    "som_10": (
        f"SELECT o_orderstatus, round(CAST(2 AS DOUBLE) * count(*) FILTER (WHERE {A}) / "
        f"((SELECT count(*) FROM orders WHERE {A}) + count(*)), 6) AS f1 FROM orders GROUP BY o_orderstatus"
    ),
    "som_12": SOM_12,
    "som_13": SOM_13,
    "som_15": union(
        [
            f"SELECT 'Root' AS name, count(*) AS size, round(count(*) FILTER (WHERE {A}) / CAST(count(*) AS DOUBLE), 4) AS coverage, "
            "false AS proposed FROM orders",
            f"SELECT 'Expensive' AS name, count(*) FILTER (WHERE {A}) AS size, 0.0::DOUBLE AS coverage, false AS proposed FROM orders",
        ]
    ),
    "fca_1": union(
        f"SELECT '{c}=' || {c} AS attribute, count(*) AS n_rows FROM orders WHERE {c} IS NOT NULL GROUP BY {c}"
        for c in ("o_orderstatus", "o_orderpriority")
    ),
    "fca_2": bins("o_totalprice", edges("o_totalprice"), "o_totalprice"),
    "fca_3": bins("o_totalprice", EVEN, "o_totalprice"),
    "fca_4": bins(SECONDS, edges(SECONDS), "o_orderdate"),
    "fca_5": f"WITH {CTX} SELECT o_orderkey, {FIELDS} FROM ctx",
    "fca_6": f"WITH {CTX} SELECT {FIELDS}, count(*) AS n FROM ctx GROUP BY s, t, y, p",
    "fca_7": CLOSED + f"SELECT {FIELDS}, size FROM cell WHERE fixed = 1",
    "fca_8": CLOSED + f"SELECT {FIELDS}, size, CAST(depth AS INTEGER) AS depth FROM found",
    "fca_9": CLOSED
    + f"SELECT {NAME.format('a')} AS parent_name, {NAME.format('b')} AS child_name FROM found a JOIN found b ON {wider('a', 'b')} "
    f"WHERE NOT EXISTS (SELECT 1 FROM found m WHERE {wider('a', 'm')} AND {wider('m', 'b')})",
    "fca_10": CLOSED
    + f", obj AS (SELECT DISTINCT s, t, y, p FROM ctx), "
    f"best AS (SELECT obj.s, obj.t, obj.y, obj.p, {NAME.format('a')} AS concept FROM obj JOIN found a ON {holds('a', 'obj')} "
    f"WHERE NOT EXISTS (SELECT 1 FROM found m WHERE {holds('m', 'obj')} AND {wider('a', 'm')})) "
    "SELECT o_orderkey, concept FROM ctx JOIN best ON " + " AND ".join(f"ctx.{c} IS NOT DISTINCT FROM best.{c}" for c in CODES),
    "fca_11": CLOSED
    + f"SELECT {FIELDS}, size FROM found a WHERE NOT EXISTS (SELECT 1 FROM found m WHERE {wider('a', 'm')})",
    "fca_12": LATTICE_AXIOMS,
    "hac_1_totals": "SELECT count(*) - 1 AS n_merges, count(*) AS root_size FROM supplier",
    "hac_4": "SELECT 'root' AS concept_id, count(*) AS n FROM supplier",
    "hac_5_rows": "SELECT s_suppkey, CAST(1 AS BIGINT) AS n_leaves FROM supplier",
    "rdf_1": f"SELECT {CUST} AS s, '{CNS}Root' AS o FROM customer",
    "rdf_2": "SELECT DISTINCT t AS text, " + local("t") + " AS local FROM (SELECT p_name AS t FROM part UNION ALL SELECT p_brand FROM part UNION ALL SELECT p_type FROM part)",
    "rdf_3": nodes(M, lambda i: f", '{ {**NAMES, 'c3': 'c01', 'c4': 'c02', 'c7': 'c03'}[i]}' AS name", id_name="concept_id", share=False),
    "rdf_4": property_rows("customer"),
    "rdf_5": "SELECT s, p, o, size FROM ("
    + values(CLASS_ROWS, ["s", "p", "o", "id"])
    + f") JOIN ({nodes(M, share=False)}) USING (id)",
    "rdf_6": union(value_rows(c) for c in ("o_orderstatus", "o_orderpriority")),
    "rdf_7": values(RDF_7_ROWS, SPOD),
    "rdf_8": values(RDF_8_ROWS, SPO + ["o_datatype"]),
    "rdf_9": values(RDF_9_ROWS, SPOD),
    "rdf_10": values(RDF_10_ROWS, SPOD),
    "rdf_11": f"SELECT '{ENS}entity_' || o_orderkey AS s, x AS o FROM ({held(M, uri)}) UNION ALL SELECT {ORDER}, {_sql(OWL + 'NamedIndividual')} FROM orders",
    "rdf_11_specific": leaf_types(),
    "rdf_12": ORDER_TRIPLES,
    "rdf_13": f"SELECT DISTINCT l_extendedprice, {lexical('l_extendedprice')} AS lexical FROM lineitem",
    "rdf_collisions": (
        f"SELECT '{CNS}url_' || u AS uri, count(*) AS n_values FROM (SELECT DISTINCT url, {local('url')} AS u FROM pages WHERE url IS NOT NULL) "
        "GROUP BY u HAVING count(*) > 1"
    ),
    "sta_1": CLASSES,
    "sta_2": EDGES,
    "sta_3": INDIVIDUALS,
    "sta_4": union(
        [
            f"SELECT class, 'root' AS role FROM ({CLASSES}) WHERE class NOT IN (SELECT child FROM ({EDGES}))",
            f"SELECT class, 'leaf' AS role FROM ({LEAVES})",
            f"SELECT child AS class, 'multi_parent' AS role FROM ({EDGES}) GROUP BY child HAVING count(*) > 1",
        ]
    ),
    "sta_5": DEPTHS,
    "sta_6": f"SELECT n_levels, avg_depth, std_depth FROM ({ORDER_STATS})",
    "sta_7": BRANCHES,
    "sta_8": INSTANCES,
    "sta_9": f"SELECT count(*) FILTER (WHERE n = 0) AS n_empty_classes FROM ({INSTANCES})",
    "sta_10": N_AND_COVERAGE,
    "sta_11": (
        "SELECT 2::BIGINT AS n_object_properties, 4::BIGINT AS n_datatype_properties, 4::BIGINT AS n_restrictions, 7::BIGINT AS n_equiv_class "
        "FROM orders LIMIT 1"
    ),
    "sta_12": f"SELECT * FROM ({ORDER_STATS}) UNION ALL BY NAME SELECT * FROM ({CUSTOMER_STATS})",
}
