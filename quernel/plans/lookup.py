"""Search and function queries over the driver's tables, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernel.functions import text as T
from quernel.functions import values as V
from quernel.operators import search
from quernel.operators.recipes import scale_items
from quernel.session import small_batches, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


FOLD_SQL = "trim(regexp_replace(replace(replace(lower(strip_accents({0})), 'đ', 'd'), 'ß', 'ss'), '\\s+', ' ', 'g'))"


@query("""
WITH p AS (SELECT p_partkey, p_name, list_distinct(string_split(lower(p_name), ' ')) AS n,
             list_distinct(string_split(lower(p_name || ' ' || p_type || ' ' || p_brand), ' ')) AS c FROM part),
s AS (SELECT p_partkey, p_name, len(list_intersect(['red', 'gear'], c)) / 2 + len(list_intersect(['red', 'gear'], n)) / 2
        + len(list_intersect(['promo'], c)) / 1 + len(list_intersect(['promo'], n)) / 1 AS score FROM p)
SELECT p_partkey, p_name, score FROM s WHERE score > 0 ORDER BY score DESC, lower(p_name), p_partkey LIMIT 20
""")
def search_topk(spark, sf):
    """Top 20 parts for 'red gear' and 'promo' by relevance, name and key."""
    part = table(spark, sf, "part")
    found = search.ranked_search(
        part, "p_partkey", F.lower("p_name"), F.lower(F.concat_ws(" ", "p_name", "p_type", "p_brand")), query="Red  GEAR", ingredients=["promo"], top_k=20
    )
    return found.select("p_partkey", "p_name", "score")


@query("""
SELECT p_partkey, p_type, p_size FROM part WHERE lower(p_type) = 'promo' AND list_has_all([lower(p_brand), lower(p_type)], ['brand#2', 'promo']) AND p_size <= 40
""")
def facet_filter(spark, sf):
    """Parts of one type whose tags contain all wanted ones and whose duration is not above a limit."""
    part = table(spark, sf, "part")
    tags = F.array(F.lower("p_brand"), F.lower("p_type"))
    time = F.concat(F.lit("PT"), F.col("p_size").cast("string"), F.lit("M"))
    rows = part.filter(search.equals_filter(F.lower("p_type"), "PROMO") & search.contains_all(tags, ["Brand#2", "promo"]) & (V.duration_minutes(time) <= 40))
    return rows.select("p_partkey", "p_type", "p_size")


@query(f"SELECT doc_id, {FOLD_SQL.format('text')} AS folded FROM documents")
def norm_text(spark, sf):
    """Accents removed, case folded, white space collapsed, for every whole text."""
    small_batches(spark)
    return table(spark, sf, "documents").select("doc_id", T.normalize_text("text").alias("folded"))


@query("""
WITH q(query_id, query) AS (VALUES (1, 'red gear'), (2, 'blue'), (3, 'small ring hot'), (4, 'bolt')),
s AS (SELECT query_id, p_partkey, CASE WHEN q.query = p_name THEN 1.0::DOUBLE WHEN contains(p_name, q.query) OR contains(q.query, p_name) THEN 0.92::DOUBLE
        ELSE len(list_intersect(string_split(q.query, ' '), string_split(p_name, ' '))) / len(string_split(q.query, ' ')) * 0.9::DOUBLE END AS similarity FROM q, part)
SELECT query_id, p_partkey, similarity, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, p_partkey) AS rank FROM s WHERE similarity > 0.4::DOUBLE) WHERE rank <= 5
""")
def fuzzy_match(spark, sf):
    """The five most similar parts for each of four queries, strictly above the threshold."""
    queries = spark.sql("SELECT * FROM VALUES (1, 'red gear'), (2, 'blue'), (3, 'small ring hot'), (4, 'bolt') AS t(query_id, query)")
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    return search.fuzzy_matches(queries, parts, 0.4, 5, ratio=False).select("query_id", F.col("id").alias("p_partkey"), "similarity", "rank")


@query("""
WITH RECURSIVE q AS (SELECT * FROM (VALUES (1, 'supplier 42'), (2, 'suplier#000000007')) t(query_id, query)),
c AS (SELECT query_id, query, s_suppkey AS id, lower(s_name) AS text FROM q CROSS JOIN supplier),
-- the longest common substring first, then what stands left and right of it
seg(query_id, id, a, b, n) AS (
    SELECT query_id, id, query, text, 0 FROM c
    UNION ALL
    SELECT s.query_id, s.id, CASE side WHEN 0 THEN left(s.a, m.i - 1) WHEN 1 THEN substr(s.a, m.i + m.k) END,
        CASE side WHEN 0 THEN left(s.b, m.j - 1) WHEN 1 THEN substr(s.b, m.j + m.k) END, CASE side WHEN 2 THEN m.k ELSE 0 END
    FROM seg s, LATERAL (
        SELECT i, k, instr(s.b, substr(s.a, i, k)) AS j FROM range(1, length(s.a) + 1) x(i), range(1, length(s.a) + 1) y(k)
        WHERE i + k <= length(s.a) + 1 AND contains(s.b, substr(s.a, i, k)) ORDER BY k DESC, i LIMIT 1
    ) m, range(3) t(side)
    WHERE s.a IS NOT NULL AND s.a <> '' AND s.b <> ''
),
r AS (SELECT query_id, id, sum(n) AS m FROM seg GROUP BY query_id, id),
s AS (SELECT query_id, id, CASE WHEN query = text THEN 1.0::DOUBLE WHEN contains(text, query) OR contains(query, text) THEN 0.92::DOUBLE
    ELSE greatest(0.9::DOUBLE * len(list_intersect(string_split(query, ' '), string_split(text, ' '))) / len(string_split(query, ' ')), 2.0::DOUBLE * m / (length(query) + length(text))) END AS similarity
  FROM c JOIN r USING (query_id, id))
SELECT query_id, id, similarity, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s WHERE similarity > 0.6::DOUBLE) WHERE rank <= 5
""")
def fuzzy_ratio(spark, sf):
    """As fuzzy_match, with the Ratcliff-Obershelp ratio, over supplier names."""
    queries = spark.sql("SELECT * FROM VALUES (1, 'supplier 42'), (2, 'suplier#000000007') AS t(query_id, query)")
    names = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.lower("s_name").alias("text"))
    return search.fuzzy_matches(queries, names, 0.6).select("query_id", "id", "similarity", "rank")


@query("""
WITH e AS (SELECT l_suppkey AS s, l_partkey AS t, l_returnflag AS label FROM lineitem)
SELECT s AS node, label FROM e UNION SELECT t, label FROM e
""")
def incident_labels(spark, sf):
    """Distinct labels of the incoming and outgoing edges of each node."""
    edges = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_returnflag").alias("label"))
    return search.incident_labels(edges)


@query("""
WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS INTEGER) AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN q % 4 = 3 THEN NULL ELSE (q % 3) * 1440 + (q % 24) * 60 + q END AS minutes FROM d
""")
def duration_minutes(spark, sf):
    """Minutes of ISO durations; those with seconds are refused."""
    q = F.col("l_quantity").cast("int")
    made = F.format_string("P%dDT%dH%dM", q % 3, q % 24, q)
    made = F.when(q % 4 == 3, F.format_string("PT%dS", q)).otherwise(made)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", V.duration_minutes(made).alias("minutes"))


@query("""
SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(round_even(l_quantity * 1.5::DOUBLE, 6) * 10 AS BIGINT)) AS BIGINT) AS tenths FROM lineitem GROUP BY l_orderkey
""")
def scale_nested(spark, sf):
    """Orders with an array of lines whose quantities are scaled in place."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_partkey").alias("name"), F.col("l_quantity").alias("quantity"))).alias("items"))
    scaled = lines.select("l_orderkey", scale_items(F.col("items"), F.lit(1.5)).alias("items"))
    tenths = F.aggregate("items", F.lit(0).cast("long"), lambda a, i: a + (i["quantity"] * 10).cast("long"))
    return scaled.select("l_orderkey", F.size("items").cast("long").alias("n"), tenths.alias("tenths"))


@query(r"""
SELECT page_id, regexp_extract(regexp_replace(url, '[/#]+$', ''), '([^/#]*)$', 1) AS local_name,
  upper(regexp_replace('has' || substr(h, 1, 1) || 'Rule', '([A-Z])', '_\1', 'g')) AS edge_type,
  lower(trim(regexp_replace(regexp_replace(replace(replace(h, '_', ' '), '-', ' '), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '\s+', ' ', 'g'))) AS readable,
  regexp_full_match(h, '[A-Za-z_][A-Za-z0-9_]*') AS safe
FROM (SELECT page_id, url, regexp_extract(url, '://([^/?#]*)', 1) AS h FROM pages WHERE NOT contains(url, '#') OR true)
""")
def case_functions(spark, sf):
    """Local names, readable names, storage names and identifier checks of page URLs."""
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    return table(spark, sf, "pages").select(
        "page_id", F.coalesce(T.local_name(F.col("url")), F.lit("")).alias("local_name"), T.upper_snake(F.concat(F.lit("has"), F.substring(host, 1, 1), F.lit("Rule"))).alias("edge_type"),
        T.humanize(host).alias("readable"), T.is_identifier(host).alias("safe"),
    )


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, CASE CAST(l_quantity AS INTEGER) % 5 WHEN 0 THEN l_quantity + l_tax WHEN 1 THEN l_quantity - l_tax WHEN 2 THEN l_quantity * l_tax
  WHEN 3 THEN CASE WHEN l_tax = 0 THEN NULL ELSE l_quantity / l_tax END END AS result FROM lineitem
""")
def calc_binary(spark, sf):
    """Arithmetic by an operator column: an unknown operator and a division by zero are null."""
    names = F.array(*[F.lit(n) for n in ("add", "subtract", "multiply", "divide", "modulo")])
    operator = F.element_at(names, (F.col("l_quantity").cast("int") % 5 + 1).cast("int"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", V.binary_result(F.col("l_quantity"), operator, F.col("l_tax")).alias("result"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE -(o_totalprice - 100) * 2::DOUBLE / (o_custkey % 7) END AS result FROM orders")
def calc_expression(spark, sf):
    """An arithmetic expression over named columns."""
    orders = table(spark, sf, "orders")
    return orders.select("o_orderkey", V.arithmetic("-(price - 100) * 2 / k", {"price": F.col("o_totalprice"), "k": F.col("o_custkey") % 7}).alias("result"))


@query("""
SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN ['cooking', role] WHEN turn % 3 = 1 THEN [role] ELSE CAST([] AS VARCHAR[]) END AS codes, trim(text) AS rest FROM conversations
""")
def slash_codes(spark, sf):
    """Leading /codes of messages, and the rest."""
    rows = table(spark, sf, "conversations")
    head = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("/cooking /"), "role", F.lit(" "))).when(F.col("turn") % 3 == 1, F.concat(F.lit("/"), "role", F.lit(" "))).otherwise(F.lit(""))
    codes, rest = T.skill_codes(F.concat(head, F.col("text")))
    return rows.select("conv_id", "turn", codes.alias("codes"), rest.alias("rest"))


@query("""
SELECT n_name AS name, r_name AS description, CAST(contains(lower(n_name || ' ' || r_name), 'asia') AS INTEGER) + CAST(contains(lower(n_name || ' ' || r_name), '_1') AS INTEGER) AS hits
FROM nation JOIN region ON r_regionkey = n_regionkey WHERE contains(lower(n_name || ' ' || r_name), 'asia') OR contains(lower(n_name || ' ' || r_name), '_1')
""")
def catalog_search(spark, sf):
    """Catalog entries by the number of query tokens in name or description."""
    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), F.expr("r_regionkey = n_regionkey"))
    return search.catalog_search(rows.select(F.col("n_name").alias("name"), F.col("r_name").alias("description")), "Asia _1")


@query("SELECT c_custkey, 'Dear ' || c_name || ' of ' || c_mktsegment || ': $unknown' AS message, ['email', 'tier'] AS unknown_keys, c_mktsegment AS segment FROM customer")
def template_and_aliases(spark, sf):
    """Template substitution that leaves unknown names, and alias keys of a map under canonical names."""
    values = F.create_map(F.lit("seg"), F.col("c_mktsegment"), F.lit("tier"), F.lit("x"), F.lit("email"), F.lit("y"))
    named = T.rename_keys(values, {"seg": "segment"})
    message = T.render_template(F.lit("Dear $name of ${segment}: $unknown"), {"name": F.col("c_name"), "segment": F.col("c_mktsegment")})
    return table(spark, sf, "customer").select("c_custkey", message.alias("message"), T.unknown_keys(named, ["segment"]).alias("unknown_keys"), named["segment"].alias("segment"))


@query("SELECT c_custkey, '$seg of ' || c_name || ' ($5): ' || c_mktsegment || 'x $namely ' || '${' || c_name || '} None $1 $ ${bad name} $seg of ' || c_name AS message FROM customer")
def template_marks(spark, sf):
    """Templates in one pass: doubled dollars, longer names, null values, values that look like marks, dollars that start none."""
    text = F.lit("$name ($$5): ${seg}x $namely $${$raw} $none $1 $ ${bad name} ${name}")
    values = {"name": F.concat(F.lit("$seg of "), "c_name"), "seg": F.col("c_mktsegment"), "raw": F.col("c_name"), "none": F.lit(None).cast("string")}
    return table(spark, sf, "customer").select("c_custkey", T.render_template(text, values).alias("message"))


@query(r"""
WITH d AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y%m%d') WHEN 2 THEN strftime(o_orderdate, '%Y-%m')
   WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') ELSE '2026-13-45' END AS t FROM orders)
SELECT o_orderkey, o_orderkey % 5 IN (0, 1) AS is_date, o_orderkey % 5 IN (0, 1, 3) AS is_datetime FROM d
""")
def iso_checks(spark, sf):
    """ISO date and date-time checks of strings in several forms."""
    day, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    text = (
        F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.date_format(day, "yyyyMMdd")).when(k == 2, F.date_format(day, "yyyy-MM"))
        .when(k == 3, F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.lit("2026-13-45"))
    )
    return table(spark, sf, "orders").select("o_orderkey", V.is_iso_date(text).alias("is_date"), V.is_iso_datetime(text).alias("is_datetime"))
