"""Stand-in tables: the norm-book model expressed over the driver's tables.

Each text is plain SQL that Spark and DuckDB both accept, so a query and the SQL it is
checked against start from the same rows.  ``{explode}`` is the one word the two differ in.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

UNIT_OF_SIZE = "CASE p_size % 5 WHEN 0 THEN '工日' WHEN 2 THEN '台班' WHEN 1 THEN 'kg' ELSE 't' END"

# l_extendedprice / l_quantity to four places, half away from zero.  Both are whole numbers
# (of cents, of pieces), so whole-number arithmetic rounds alike in every engine.
UNIT_PRICE = ("CAST(FLOOR((CAST(ROUND(l_extendedprice * 100) AS BIGINT) * 200 + CAST(l_quantity AS BIGINT)) "
              "/ (2 * l_quantity)) AS DOUBLE) / CAST(10000 AS DOUBLE)")

VIEWS: dict[str, str] = {
    "chapter": """
SELECT CAST(1 + r_regionkey AS BIGINT) AS chap_ID, CAST(0 AS BIGINT) AS chap_PID,
       r_name AS chap_Name, lpad(CAST(r_regionkey + 1 AS STRING), 2, '0') AS chap_code
FROM region
UNION ALL
SELECT CAST(100 + n_nationkey AS BIGINT), CAST(1 + n_regionkey AS BIGINT), n_name,
       concat(lpad(CAST(n_regionkey + 1 AS STRING), 2, '0'), '.', lpad(CAST(n_nationkey AS STRING), 2, '0'))
FROM nation
UNION ALL
SELECT CAST(1000 + c_custkey AS BIGINT), CAST(100 + c_nationkey AS BIGINT), c_name,
       concat(lpad(CAST(n_regionkey + 1 AS STRING), 2, '0'), '.', lpad(CAST(n_nationkey AS STRING), 2, '0'),
              '.', lpad(CAST(c_custkey AS STRING), 8, '0'))
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "norm": """
SELECT o_orderkey AS norm_ID, CAST(1000 + o_custkey AS BIGINT) AS chap_ID,
       concat(substr(o_orderpriority, 1, 1), '-', CAST(o_orderkey % 997 AS STRING)) AS norm_Code,
       concat(o_orderpriority, ' ', o_orderstatus) AS norm_Name,
       substr('ABCDE', n_regionkey + 1, 1) AS vol,
       CAST(o_orderkey % 10 AS DOUBLE) AS norm_OtherPrice
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "consumption": f"""
SELECT vol, p_partkey AS cons_ID,
       CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_partkey END AS master_res_ID,
       3 + p_size % 5 AS cons_Style, lpad(CAST(p_size % 10 AS STRING), 2, '0') AS kind_Code,
       p_name AS cons_Name, p_type AS cons_Standard, {UNIT_OF_SIZE} AS cons_Units
FROM (SELECT q.*, {{explode}}(split('A,B,C,D,E', ',')) AS vol FROM part q) p""",
    "content": """
SELECT l_orderkey AS norm_ID, l_partkey AS cons_ID, l_quantity AS cont_Amount FROM lineitem""",
    "resource": f"""
SELECT p_partkey AS res_ID, concat('R', lpad(CAST(p_partkey AS STRING), 8, '0')) AS res_Code,
       3 + p_size % 5 AS res_Class, p_name AS res_Name, p_type AS res_Standard,
       p_brand AS res_Family, {UNIT_OF_SIZE} AS res_Unit
FROM part""",
    "resource_price": f"""
SELECT l_partkey AS res_ID, r_name AS pack, CAST(l_shipdate AS DATE) AS price_date,
       CASE WHEN MIN(l_discount) = 0 THEN NULL
            ELSE MIN({UNIT_PRICE}) END AS price,
       CASE r_regionkey WHEN 0 THEN 'T1' WHEN 1 THEN 'T2' WHEN 2 THEN 'T3' WHEN 3 THEN 'T4' ELSE 'D' END AS tier
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
     JOIN region ON n_regionkey = r_regionkey
WHERE l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '1998-01-01 00:00:00'
GROUP BY l_partkey, r_name, r_regionkey, CAST(l_shipdate AS DATE)""",
    "price_pack": """
SELECT r_name AS pack, CASE WHEN r_regionkey IN (2, 3) THEN 'active' ELSE 'inactive' END AS status,
       CASE r_regionkey WHEN 0 THEN 'THB' WHEN 1 THEN 'CNY' ELSE 'USD' END AS currency
FROM region""",
    "price_quote": f"""
SELECT l_partkey * 1000000 + l_suppkey AS quote_ID, l_partkey AS res_ID,
       concat(MIN(p_name), ' ', MIN(p_type)) AS name, MIN(s_name) AS supplier,
       CAST(MAX(l_shipdate) AS DATE) AS quote_date,
       MIN({UNIT_PRICE}) AS price_incl
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
WHERE l_returnflag = 'A'
GROUP BY l_partkey, l_suppkey""",
    "page_line": """
SELECT user_id AS page, event_id AS line_id, CAST((event_id * 37) % 600 AS DOUBLE) AS x,
       value AS y, event_type AS text
FROM events""",
}

# Tables that an operator derives; only the checking SQL needs their text.
DERIVED: dict[str, str] = {
    "usage": """
SELECT c.master_res_ID AS res_ID, c.vol, c.cons_ID, c.cons_Style, c.kind_Code, c.cons_Name,
       c.cons_Standard, c.cons_Units, count(t.norm_ID) AS refs
FROM consumption c
LEFT JOIN (SELECT n.vol, ct.cons_ID, n.norm_ID FROM content ct JOIN norm n ON n.norm_ID = ct.norm_ID) t
  ON t.vol = c.vol AND t.cons_ID = c.cons_ID
WHERE c.master_res_ID IS NOT NULL
GROUP BY ALL""",
    "latest_row": """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY res_ID, pack ORDER BY price_date DESC) AS rn
               FROM resource_price) WHERE rn = 1""",
    "latest_price": """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY res_ID, pack ORDER BY price_date DESC) AS rn
               FROM resource_price WHERE price IS NOT NULL) WHERE rn = 1""",
    "closure": """
SELECT chap_ID AS node, chap_ID AS ancestor, 0 AS distance FROM chapter
UNION ALL
SELECT c.chap_ID, p.chap_ID, 1 FROM chapter c JOIN chapter p ON c.chap_PID = p.chap_ID
UNION ALL
SELECT c.chap_ID, g.chap_ID, 2 FROM chapter c JOIN chapter p ON c.chap_PID = p.chap_ID
JOIN chapter g ON p.chap_PID = g.chap_ID""",
}


def define_view(name: str, text: str) -> None:
    """Adds a stand-in table built from the driver's tables or earlier stand-ins."""
    VIEWS[name] = text


def define_derived(name: str, text: str) -> None:
    """Adds the checking SQL of a table that an operator derives."""
    DERIVED[name] = text


def _closure(body: str, texts: dict[str, str]) -> list[str]:
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name in texts:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql):
                visit(texts[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    return needed


def with_bindings(body: str, explode: str = "unnest", texts: dict[str, str] | None = None) -> str:
    """Prefixes ``body`` with the stand-ins it reads, in dependency order."""
    texts = {**VIEWS, **DERIVED} if texts is None else texts
    needed = _closure(body, texts)
    if not needed:
        return body.replace("{explode}", explode)
    heads = ",\n".join(f"{n} AS ({texts[n].strip()}\n)" for n in needed)
    body = body.strip()
    joined = f"WITH {heads},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {heads}\n{body}"
    return joined.replace("{explode}", explode)


class Tables:
    """The driver's tables and stand-ins of one folder, as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._seen: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._seen:
            self._seen[name] = self._load(name)
        return self._seen[name]

    def _load(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name not in VIEWS:
            raise AttributeError(f"no table {name!r}")
        text = VIEWS[name].replace("{explode}", "explode")
        inner = [n for n in (*BASE_TABLES, *VIEWS) if re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", text)]
        # spark.sql binds each DataFrame argument by name for this one statement
        text = text.replace("{", "{{").replace("}", "}}")
        for n in inner:
            text = re.sub(rf"\b(FROM|JOIN)(\s+){n}\b", rf"\1\2{{{n}}}", text)
        return self.spark.sql(text, **{n: getattr(self, n) for n in inner})
