"""Registered queries of audits, preparation and charts, and the integrated job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.columns import rounded
from quarry.operators import audit, charts, prep
from quarry.plans.audited_regression import audited_regression
from quarry.plans.registry import query
from quarry.sources.tables import table, tables

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
FOLD = "('0x' || substr(md5({0}::VARCHAR), 1, 8))::BIGINT % {1}"


def check_sql(name: str, column: str, good: str, source: str, most: float = 0.0) -> str:
    return f"SELECT '{name}' AS check_name, '{column}' AS column_name, count(*) AS n_rows, count(*) FILTER (NOT coalesce({good}, false)) AS n_bad, count(*) FILTER (NOT coalesce({good}, false)) <= {most} * count(*) AS pass FROM {source}"


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n, count(*) FILTER ({c} IS NULL) AS n_null, count(DISTINCT {c}) AS n_distinct, min({c})::DOUBLE AS low, max({c})::DOUBLE AS high, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS deviation, round(quantile_cont({c}, 0.25), 4) AS q1, round(median({c}), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS q3, round(kurtosis_pop({c}), 4) AS kurtosis FROM lineitem" for c in NUMBERS))
def au01_profile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(audit.profile(table(spark, d, "lineitem").select(*NUMBERS)))


NULLS = "(SELECT * REPLACE (CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS o_totalprice) FROM orders)"


def gapped(spark: SparkSession, d: str) -> DataFrame:
    return prep.planted_nulls(table(spark, d, "orders"), "o_totalprice", F.col("o_orderkey") % 11 == 0)


@query(" UNION ALL ".join(check_sql("completeness", c, f"{c} IS NOT NULL", NULLS, 0.05) for c in ("o_orderkey", "o_totalprice")))
def au02_completeness(spark: SparkSession, d: str) -> DataFrame:
    return audit.completeness(gapped(spark, d), ["o_orderkey", "o_totalprice"], 0.95)


@query("WITH g AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber) SELECT sum(n)::BIGINT AS n_rows, count(*) FILTER (n > 1) AS n_groups, sum(n - 1)::BIGINT AS n_extra, sum(n - 1) = 0 AS pass FROM g")
def au03_uniqueness(spark: SparkSession, d: str) -> DataFrame:
    return audit.uniqueness(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(check_sql("domain", "o_orderstatus", "o_orderstatus IN ('F', 'O')", "orders") + " UNION ALL " + check_sql("range", "c_acctbal", "c_acctbal BETWEEN 0 AND 9000", "customer"))
def au04_domain_range(spark: SparkSession, d: str) -> DataFrame:
    return audit.in_domain(table(spark, d, "orders"), "o_orderstatus", ["F", "O"]).unionByName(audit.in_range(table(spark, d, "customer"), "c_acctbal", 0, 9000))


@query(check_sql("pattern", "c_name", "regexp_matches(c_name, '[02468]$')", "customer"))
def au05_matches(spark: SparkSession, d: str) -> DataFrame:
    return audit.matches(table(spark, d, "customer"), "c_name", "[02468]$")


@query("SELECT (SELECT count(*) FROM lineitem ANTI JOIN orders ON l_orderkey = o_orderkey) AS n_orphans, (SELECT count(*) FROM orders ANTI JOIN lineitem ON l_orderkey = o_orderkey) AS n_childless")
def au06_foreign_key(spark: SparkSession, d: str) -> DataFrame:
    return audit.foreign_key(*tables(spark, d, "lineitem", "orders"), ("l_orderkey", "o_orderkey"))


def shipped(spark: SparkSession, d: str) -> DataFrame:
    line, orders = tables(spark, d, "lineitem", "orders")
    return line.join(orders, line.l_orderkey == orders.o_orderkey)


@query(check_sql("ships after order", "*", "l_shipdate >= o_orderdate", "lineitem JOIN orders ON l_orderkey = o_orderkey"))
def au07_row_rule(spark: SparkSession, d: str) -> DataFrame:
    return audit.row_rule(shipped(spark, d), "ships after order", F.col("l_shipdate") >= F.col("o_orderdate"))


@query("WITH g AS (SELECT count(DISTINCT p_brand) AS n FROM part GROUP BY p_name) SELECT count(*) AS n_values, count(*) FILTER (n > 1) AS n_bad, count(*) FILTER (n > 1) = 0 AS pass FROM g")
def au08_functional_dependency(spark: SparkSession, d: str) -> DataFrame:
    return audit.functional_dependency(table(spark, d, "part"), "p_name", "p_brand")


@query("SELECT 'l_comment' AS column_name, 'missing' AS problem, count(*) AS n_rows, count(*) AS n_unfit FROM lineitem UNION ALL SELECT 'l_tax', 'extra', count(*), 0 FROM lineitem UNION ALL SELECT 'l_extendedprice', 'type', count(*), count(*) FILTER (l_extendedprice <> floor(l_extendedprice)) FROM lineitem")
def au09_schema_check(spark: SparkSession, d: str) -> DataFrame:
    """The columns that differ from a contract, and how many rows can't be read by it."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_tax")
    return audit.schema_fit(line, T.StructType().add("l_orderkey", line.schema["l_orderkey"].dataType).add("l_extendedprice", T.LongType()).add("l_comment", T.StringType()))


@query("WITH g AS (SELECT event_type, ts, ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) AS gap FROM events) SELECT event_type, (epoch_us(TIMESTAMP '2030-01-01') - epoch_us(max(ts))) / 1e6 AS age_seconds, epoch_us(max(gap)) / 1e6 AS longest_gap_seconds FROM g GROUP BY 1")
def au10_freshness(spark: SparkSession, d: str) -> DataFrame:
    return audit.freshness(table(spark, d, "events"), "ts", ["event_type"], "2030-01-01")


BINS = [10.0, 20.0, 40.0, 80.0, 160.0]


def halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, d, "events")
    return events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1")


PSI_BIN = " + ".join(f"(value >= {b})::INT" for b in BINS)


@query(f"""WITH k AS (SELECT event_id % 2 AS h, {PSI_BIN} AS v FROM events), g AS (SELECT v.v, count(*) FILTER (h = 0) AS b, count(*) FILTER (h = 1) AS c FROM unnest(range(0, 6)) v(v) LEFT JOIN k ON k.v = v.v GROUP BY 1),
s AS (SELECT (b + 0.5) / (sum(b) OVER () + 3.0) AS p, (c + 0.5) / (sum(c) OVER () + 3.0) AS q FROM g) SELECT round(sum((q - p) * ln(q / p)), 6) AS psi FROM s""")
def au11_psi(spark: SparkSession, d: str) -> DataFrame:
    return rounded(audit.psi(*halves(spark, d), "value", BINS), 6)


@query("""WITH k AS (SELECT DISTINCT value FROM events), e AS (SELECT value, count(*) FILTER (event_id % 2 = 0) AS b, count(*) FILTER (event_id % 2 = 1) AS c FROM events GROUP BY 1),
r AS (SELECT sum(b) OVER (ORDER BY value) / sum(b) OVER () AS x, sum(c) OVER (ORDER BY value) / sum(c) OVER () AS y FROM e) SELECT round(max(abs(x - y)), 6) AS ks FROM r""")
def au12_ks(spark: SparkSession, d: str) -> DataFrame:
    return rounded(audit.ks(*halves(spark, d), "value"), 6)


@query()
def au12b_ks_sketched(spark: SparkSession, d: str) -> DataFrame:
    return audit.ks_sketched(*halves(spark, d), "value")


@query("""WITH g AS (SELECT event_type, event_id % 2 AS h, count(*) AS n FROM events GROUP BY ALL), x AS (SELECT n, sum(n) OVER (PARTITION BY event_type) * sum(n) OVER (PARTITION BY h) / sum(n) OVER () AS e, event_type FROM g)
SELECT round(sum((n - e) ** 2 / e), 6) AS statistic, count(DISTINCT event_type) - 1 AS degrees FROM x""")
def au13_chi_square(spark: SparkSession, d: str) -> DataFrame:
    return rounded(audit.chi_square(*halves(spark, d), "event_type"), 6)


@query("SELECT sha256(coalesce(text, '')) AS content_hash, count(*) AS n, min(doc_id) AS first_key FROM documents GROUP BY 1 HAVING count(*) > 1")
def au14_duplicate_content(spark: SparkSession, d: str) -> DataFrame:
    return audit.duplicate_content(table(spark, d, "documents"), "doc_id", ["text"])


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "ipv4": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"}


@query(" UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) FILTER (regexp_matches(text, '{p}')) AS n_rows, sum(len(regexp_extract_all(text, '{p}')))::BIGINT AS n_hits FROM documents" for k, p in PII.items()))
def au15_pii_scan(spark: SparkSession, d: str) -> DataFrame:
    return audit.pii_scan(table(spark, d, "documents"), "text", PII)


@query(f"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '{PII['email']}', '<email>', 'g'), '{PII['ipv4']}', '<ipv4>', 'g')) AS masked FROM documents")
def au16_mask(spark: SparkSession, d: str) -> DataFrame:
    return audit.mask(table(spark, d, "documents"), "text", PII).select("doc_id", F.md5("text").alias("masked"))


@query("""WITH b AS (SELECT o_orderkey + (CASE WHEN o_orderkey % 100 = 0 THEN 100000000 ELSE 0 END) AS o_orderkey, o_totalprice + (o_orderkey % 50 = 1)::INT AS o_totalprice, o_orderstatus FROM orders)
SELECT CASE WHEN b.o_orderkey IS NULL THEN 'only_left' WHEN a.o_orderkey IS NULL THEN 'only_right' WHEN a.o_totalprice = b.o_totalprice AND a.o_orderstatus = b.o_orderstatus THEN 'equal' ELSE 'differing' END AS status, count(*) AS n FROM orders a FULL JOIN b ON a.o_orderkey = b.o_orderkey GROUP BY 1""")
def au17_reconcile(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    b = a.withColumn("o_totalprice", F.col("o_totalprice") + (F.col("o_orderkey") % 50 == 1).cast("int")).withColumn("o_orderkey", F.col("o_orderkey") + F.when(F.col("o_orderkey") % 100 == 0, 100000000).otherwise(0))
    return audit.reconcile(a, b, ["o_orderkey"], ["o_totalprice", "o_orderstatus"])


CARD = [("positive", "o_totalprice", "o_totalprice > 0", "orders", 2.0), ("known", "o_orderstatus", "o_orderstatus IN ('F', 'O')", "orders", 1.0), ("positive", "c_acctbal", "c_acctbal > 0", "customer", 1.0)]


@query("WITH c AS (" + " UNION ALL ".join(f"SELECT *, {w}::DOUBLE AS weight FROM ({check_sql(n, c, g, t)})" for n, c, g, t, w in CARD) + ") SELECT *, round(sum(CASE WHEN pass THEN weight ELSE 0 END) OVER () / sum(weight) OVER (), 4) AS pass_rate FROM c")
def au18_scorecard(spark: SparkSession, d: str) -> DataFrame:
    return rounded(audit.scorecard([(table(spark, d, t), [(n, c, F.expr(g), w) for n, c, g, own, w in CARD if own == t]) for t in ("orders", "customer")]))


SPLIT = f"SELECT *, {FOLD.format('o_orderkey', 5)} AS fold FROM {NULLS}"


@query(f"WITH s AS ({SPLIT}) SELECT o_orderkey, round(coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM s WHERE fold <> 0)), 4) AS o_totalprice, o_totalprice IS NULL AS o_totalprice_was_missing FROM s")
def pr01_impute(spark: SparkSession, d: str) -> DataFrame:
    from quarry.operators.regression import hash_split

    rows = hash_split(gapped(spark, d), "o_orderkey", 5)
    return rounded(prep.impute(rows.where("fold <> 0"), rows, ["o_totalprice"], "mean").select("o_orderkey", "o_totalprice", "o_totalprice_was_missing"))


@query(f"WITH s AS ({SPLIT}) SELECT o_orderkey, round(coalesce(o_totalprice, (SELECT median(o_totalprice) FROM s WHERE fold <> 0)), 4) AS o_totalprice, o_totalprice IS NULL AS o_totalprice_was_missing FROM s")
def pr01b_impute_median(spark: SparkSession, d: str) -> DataFrame:
    from quarry.operators.regression import hash_split

    rows = hash_split(gapped(spark, d), "o_orderkey", 5)
    return rounded(prep.impute(rows.where("fold <> 0"), rows, ["o_totalprice"], "median").select("o_orderkey", "o_totalprice", "o_totalprice_was_missing"))


@query("WITH q AS (SELECT quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.99) AS b FROM events WHERE event_id % 5 <> 0) SELECT event_id, round(greatest(least(value, b), a), 4) AS value FROM events, q")
def pr02_winsorize(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    return rounded(prep.winsorize(events.where("event_id % 5 <> 0"), events, ["value"], 0.01, 0.99).select("event_id", "value"))


@query("WITH t AS (SELECT * FROM part WHERE p_partkey % 5 <> 0), q AS (SELECT min(p_retailprice) AS a, max(p_retailprice) AS b, quantile_cont(p_retailprice, [0.25, 0.5, 0.75]) AS c FROM t) SELECT p_partkey, greatest(0, least(9, floor((p_retailprice - a) * 10 / (b - a))))::INT AS width, len(list_filter(c, lambda x: x < p_retailprice))::INT AS quarter FROM part, q")
def pr03_bucketize(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", "p_retailprice")
    train = part.where("p_partkey % 5 <> 0")
    wide = prep.bucketize(train, part, "p_retailprice", 10).withColumnRenamed("bucket", "width")
    return prep.bucketize(train, wide, "p_retailprice", 4, "count").withColumnRenamed("bucket", "quarter").drop("p_retailprice")


@query("WITH t AS (SELECT c_mktsegment AS s FROM customer WHERE c_custkey % 5 <> 0 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3), r AS (SELECT s, row_number() OVER (ORDER BY s) AS i FROM t) SELECT c_custkey, " + ", ".join(f"(c_mktsegment = (SELECT s FROM r WHERE i = {i}))::INT AS level_{i}, (SELECT 'c_mktsegment_' || s FROM r WHERE i = {i}) AS name_{i}" for i in (1, 2, 3)) + ", (c_mktsegment NOT IN (SELECT s FROM t))::INT AS c_mktsegment_other FROM customer")
def pr04_one_hot(spark: SparkSession, d: str) -> DataFrame:
    """The columns by the order of their names, and their names, since which levels are commonest depends on the table."""
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    made = prep.one_hot(rows.where("c_custkey % 5 <> 0"), rows, "c_mktsegment", 3)
    hot = sorted(c for c in made.columns if c.startswith("c_mktsegment_") and c != "c_mktsegment_other")
    return made.select("c_custkey", *[x for i, c in enumerate(hot) for x in (F.col(c).alias(f"level_{i + 1}"), F.lit(c).alias(f"name_{i + 1}"))], "c_mktsegment_other")


@query(f"""WITH f AS (SELECT *, {FOLD.format('p_partkey', 5)} AS fold FROM part), g AS (SELECT p_brand, fold, sum(p_retailprice) AS s, count(*) AS n FROM f GROUP BY ALL), a AS (SELECT fold, sum(s) AS s, sum(n) AS n FROM g GROUP BY 1), w AS (SELECT sum(s) AS s, sum(n) AS n FROM g), b AS (SELECT p_brand, sum(s) AS s, sum(n) AS n FROM g GROUP BY 1)
SELECT p_partkey, round((b.s - g.s + 10 * (w.s - a.s) / (w.n - a.n)) / (b.n - g.n + 10), 4) AS encoded FROM f JOIN g USING (p_brand, fold) JOIN a USING (fold) JOIN b USING (p_brand), w""")
def pr05_target_encode(spark: SparkSession, d: str) -> DataFrame:
    from quarry.operators.regression import hash_split

    rows = hash_split(table(spark, d, "part"), "p_partkey", 5)
    return rounded(prep.target_encode(rows, "p_brand", "p_retailprice", "fold").select("p_partkey", "encoded"))


@query("SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id::VARCHAR), doc_id) <= ceil(0.2 * count(*) OVER (PARTITION BY quality)) AS is_test FROM labels")
def pr06_stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return prep.stratified_split(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "quality", 0.2)


@query("WITH t AS (SELECT * FROM documents WHERE doc_id % 5 <> 0), s AS (SELECT * FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0) SELECT (SELECT count(*) FROM s WHERE doc_id IN (SELECT doc_id FROM t)) AS n_keys, (SELECT count(*) FROM s WHERE sha256(text) IN (SELECT sha256(text) FROM t)) AS n_contents")
def pr07_leakage(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return prep.leakage(docs.where("doc_id % 5 <> 0"), docs.where("doc_id % 5 = 0 OR doc_id % 7 = 0"), "doc_id", ["text"])


@query("WITH g AS (SELECT least(floor(value / 10), 19)::INT AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 200 GROUP BY 1) SELECT b::INT AS bin, b * 10.0::DOUBLE AS low, (b + 1) * 10.0::DOUBLE AS high, coalesce(n, 0) AS n FROM unnest(range(0, 20)) r(b) LEFT JOIN g ON bin = b")
def vz01_histogram(spark: SparkSession, d: str) -> DataFrame:
    return charts.histogram(table(spark, d, "events"), "value", 0.0, 200.0, 20)


@query("""WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, median(value) AS md, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1), e AS (SELECT *, value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS ok FROM events JOIN q USING (event_type))
SELECT event_type, round(e.q1, 4) AS q1, round(md, 4) AS median, round(e.q3, 4) AS q3, min(value) FILTER (ok) AS whisker_low, max(value) FILTER (ok) AS whisker_high, count(*) FILTER (NOT ok) AS n_outliers FROM e GROUP BY event_type, e.q1, md, e.q3""")
def vz02_boxplot(spark: SparkSession, d: str) -> DataFrame:
    return rounded(charts.boxplot(table(spark, d, "events"), "value", ["event_type"]))


@query("SELECT l_quantity AS value, count(*) AS n, round(sum(count(*)) OVER (ORDER BY l_quantity) / (SELECT count(*) FROM lineitem), 6) AS share FROM lineitem GROUP BY 1")
def vz03_ecdf(spark: SparkSession, d: str) -> DataFrame:
    return rounded(charts.ecdf(table(spark, d, "lineitem"), "l_quantity"), 6)


SHARES = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]


@query("WITH c AS (SELECT value, count(*) AS n, sum(count(*)) OVER (ORDER BY value) / (SELECT count(*) FROM events) AS share FROM events GROUP BY 1) SELECT p AS asked, arg_min(value, value) AS value, arg_min(n, value) AS n, round(arg_min(share, value), 6) AS share FROM c, (VALUES " + ", ".join(f"({p}::DOUBLE)" for p in SHARES) + ") s(p) WHERE share >= p GROUP BY 1")
def vz03b_ecdf_at_shares(spark: SparkSession, d: str) -> DataFrame:
    return rounded(charts.ecdf(table(spark, d, "events"), "value", SHARES), 6)


@query("SELECT ts AS value, count(*) AS n, round(sum(count(*)) OVER (ORDER BY ts) / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY 1")
def vz03c_ecdf_of_times(spark: SparkSession, d: str) -> DataFrame:
    return rounded(charts.ecdf(table(spark, d, "events"), "ts"), 6)


@query()
def vz03d_ecdf_sketched(spark: SparkSession, d: str) -> DataFrame:
    return charts.ecdf_sketched(table(spark, d, "events"), "value", SHARES)


RANK = "WITH r AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS {c}" for c in NUMBERS) + " FROM lineitem) "
PAIRS = [(a, b) for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]]


@query(RANK + " UNION ALL ".join(f"SELECT '{how}' AS how, '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 4) AS corr FROM {t}" for how, t in (("pearson", "lineitem"), ("spearman", "r")) for a, b in PAIRS))
def vz04_corr_matrix(spark: SparkSession, d: str) -> DataFrame:
    made = [charts.corr_matrix(table(spark, d, "lineitem"), NUMBERS, how).withColumn("how", F.lit(how)) for how in ("pearson", "spearman")]
    return rounded(made[0].unionByName(made[1]))


@query("WITH e AS (SELECT min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_extendedprice) AS y0, max(l_extendedprice) AS y1 FROM lineitem) SELECT least(floor((l_quantity - x0) * 10 / (x1 - x0)), 9)::INT AS ix, least(floor((l_extendedprice - y0) * 8 / (y1 - y0)), 7)::INT AS iy, count(*) AS n FROM lineitem, e GROUP BY 1, 2")
def vz05_grid_counts(spark: SparkSession, d: str) -> DataFrame:
    return charts.grid_counts(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", 10, 8)


@query("WITH g AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY o_orderstatus), 4) AS row_share, round(n / sum(n) OVER (PARTITION BY o_orderpriority), 4) AS column_share FROM g")
def vz06_crosstab(spark: SparkSession, d: str) -> DataFrame:
    return rounded(charts.crosstab(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority"))


@query("WITH g AS (SELECT p_name AS label, count(*) AS n FROM part GROUP BY 1), t AS (SELECT * FROM g ORDER BY n DESC, label LIMIT 10) SELECT * FROM t UNION ALL SELECT 'other', (SELECT sum(n) FROM g)::BIGINT - (SELECT sum(n) FROM t)::BIGINT")
def vz07_top_other(spark: SparkSession, d: str) -> DataFrame:
    return charts.top_other(table(spark, d, "part"), "p_name", 10)


@query("SELECT event_type, epoch_us(ts) // 21600000000 AS bucket, arg_min(value, (ts, event_id)) AS first, arg_max(value, (ts, event_id)) AS last, min(value) AS low, max(value) AS high FROM events GROUP BY 1, 2")
def vz08_m4(spark: SparkSession, d: str) -> DataFrame:
    return charts.m4(table(spark, d, "events"), "ts", "value", "event_id", 21600, ["event_type"])


@query("SELECT event_type, count(value) AS n, round(avg(value), 4) AS mean, round(avg(value) - 1.96 * stddev_samp(value) / sqrt(count(value)), 4) AS low, round(avg(value) + 1.96 * stddev_samp(value) / sqrt(count(value)), 4) AS high FROM events GROUP BY 1")
def vz09_mean_interval(spark: SparkSession, d: str) -> DataFrame:
    return rounded(charts.mean_interval(table(spark, d, "events"), "value", ["event_type"]))


@query("""WITH a AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey), k AS (SELECT *, month(o_orderdate) AS month, isodow(o_orderdate) >= 6 AS is_weekend, ('0x' || substr(md5(l_orderkey::VARCHAR), 1, 8))::BIGINT % 5 AS fold FROM a WHERE l_shipdate >= o_orderdate AND l_extendedprice > 0),
g AS (SELECT l_returnflag, month, avg(l_extendedprice) AS m FROM k WHERE fold <> 0 GROUP BY ALL), p AS (SELECT k.*, l_extendedprice AS y, coalesce(m, (SELECT avg(l_extendedprice) FROM k WHERE fold <> 0)) AS yhat FROM k LEFT JOIN g USING (l_returnflag, month) WHERE fold = 0)
SELECT is_weekend, (SELECT count(*) FROM a) AS n_joined, (SELECT count(*) FROM k) AS n_passed, (SELECT count(*) FROM k WHERE fold <> 0) AS n_train, count(*) AS n, round(avg(abs(y - yhat)), 4) AS mae, round(sqrt(avg((y - yhat) ** 2)), 4) AS rmse FROM p GROUP BY 1""")
def in01_audited_regression(spark: SparkSession, d: str) -> DataFrame:
    return rounded(audited_regression(*tables(spark, d, "lineitem", "orders")))
