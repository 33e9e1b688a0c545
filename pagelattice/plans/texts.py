"""Queries over strings, paths, configuration lines and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelattice import views as V
from pagelattice.functions import text as T
from pagelattice.plans.registry import query

c = F.col


@query("str1", "names", "SELECT id, CAST(levenshtein(a, b) AS BIGINT) AS d FROM names")
def str1(spark, d):
    return V.names(spark, d).select("id", T.byte_distance(c("a"), c("b")).alias("d"))


@query("eva1", "names", "SELECT id, CAST(floor(levenshtein(a, b) / CAST(greatest(strlen(a), 1) AS DOUBLE) * 1000000 + 0.5) AS BIGINT) AS cer FROM names")
def eva1(spark, d):
    return V.names(spark, d).select("id", F.floor(T.error_rate(c("a"), c("b")) * 1e6 + 0.5).cast("long").alias("cer"))


@query("str2", "", "SELECT doc_id, (length(text) - length(translate(text, 'ilI', ''))) * 2 > length(text) AS v FROM documents")
def str2(spark, d):
    return V.load(spark, d, "documents").select("doc_id", T.is_repetitive(c("text")).alias("v"))


@query("flt17", "", "SELECT doc_id FROM documents WHERE (length(text) - length(translate(text, 'ilI', ''))) * 10 > length(text)")
def flt17(spark, d):
    """Texts of which a tenth is upright strokes."""
    return V.load(spark, d, "documents").where((F.length("text") - F.length(F.translate("text", "ilI", ""))) * 10 > F.length("text")).select("doc_id")


@query("str3", "paths", "SELECT id, split_part(p, '/', -1) AS v FROM paths")
def str3(spark, d):
    return V.paths(spark, d).select("id", T.file_name(c("p")).alias("v"))


@query("str4", "paths", "SELECT id, regexp_replace(split_part(p, '/', -1), '\\.[^.]*$', '') AS v FROM paths")
def str4(spark, d):
    return V.paths(spark, d).select("id", T.stem(c("p")).alias("v"))


@query("str5", "paths", "SELECT id, replace(p, 'example', 'sample') AS v FROM paths")
def str5(spark, d):
    return V.paths(spark, d).select("id", F.replace(c("p"), F.lit("example"), F.lit("sample")).alias("v"))


@query("str6", "paths", "SELECT id, split_part(p, '=', 1) AS k, CASE WHEN instr(p, '=') > 0 THEN substr(p, instr(p, '=') + 1) END AS v FROM paths")
def str6(spark, d):
    return V.paths(spark, d).select("id", T.key_of(c("p")).alias("k"), T.value_of(c("p")).alias("v"))


@query("str7", "", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def str7(spark, d):
    turns = V.load(spark, d, "conversations").where("text is not null")
    return T.joined_lines(turns, "conv_id", "turn", "text")


@query("src6", "", "SELECT l_orderkey AS f, n, k AS key, v AS value FROM (SELECT *, max(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY n ROWS UNBOUNDED PRECEDING) AS b FROM (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) * 100000000000 + l_partkey * 10000 + l_suppkey AS n, l_returnflag AS k, l_linestatus || '=' || l_linenumber AS v, l_quantity >= 45 AS bad FROM lineitem)) WHERE b = 0")
def src6(spark, d):
    """Configuration files made of line items: key = value lines up to the first line that has no equals sign."""
    line = F.when(c("l_quantity") >= 45, F.lit("# comment")).otherwise(F.concat(c("l_returnflag"), F.lit("="), c("l_linestatus"), F.lit("="), c("l_linenumber")))
    rows = V.load(spark, d, "lineitem").select(c("l_orderkey").alias("f"), (c("l_linenumber").cast("long") * 100000000000 + c("l_partkey") * 10000 + c("l_suppkey")).alias("n"), line.alias("line"))
    return T.config_lines(rows, "f", "n", "line")


@query("src10", "", "SELECT a.page_id AS id, b.doc_id FROM pages a JOIN documents b ON CAST(regexp_extract(a.url, '/(\\d+)', 1) AS VARCHAR) = CAST(b.doc_id AS VARCHAR)")
def src10(spark, d):
    """Files paired with their ground truth by stem."""
    pages = V.load(spark, d, "pages").select(c("page_id").alias("id"), F.regexp_extract("url", r"/(\d+)", 1).alias("stem"))
    return pages.join(V.load(spark, d, "documents").select("doc_id", c("doc_id").cast("string").alias("stem")), "stem").select("id", "doc_id")


@query("joi16", "", "SELECT a.c_custkey AS id, b.s_suppkey AS other FROM customer a JOIN supplier b ON split_part(a.c_name, '#', 2) = split_part(b.s_name, '#', 2)")
def joi16(spark, d):
    """Truth and reading paired by the stem of their names."""
    stem = lambda n: F.split_part(c(n), F.lit("#"), F.lit(2))
    a = V.load(spark, d, "customer").select(c("c_custkey").alias("id"), stem("c_name").alias("k"))
    return a.join(V.load(spark, d, "supplier").select(c("s_suppkey").alias("other"), stem("s_name").alias("k")), "k").select("id", "other")


@query("mth1", "segments", "SELECT img, id, x1 * x1 AS sq, abs(x1 - x2) AS ab, CAST(sign(x1 - x2) AS BIGINT) AS sg, CAST(floor(exp(-CAST(score AS DOUBLE) * score / 800) * 1000000 + 0.5) AS BIGINT) AS ga FROM segments")
def mth1(spark, d):
    s = V.segments(spark, d)
    return s.select("img", "id", (c("x1") * c("x1")).alias("sq"), F.abs(c("x1") - c("x2")).alias("ab"), F.signum(c("x1") - c("x2")).cast("long").alias("sg"), F.floor(F.exp(-c("score").cast("double") * c("score") / 800) * 1e6 + 0.5).cast("long").alias("ga"))


@query("mth9", "segments", "SELECT img, id, CASE WHEN x1 + x2 + y1 + y2 > 0 THEN CAST(floor((CASE WHEN x1 + x2 > 0 THEN CAST((x1 - x2) * (x1 - x2) AS DOUBLE) / (x1 + x2) ELSE 0.0::DOUBLE END + CASE WHEN y1 + y2 > 0 THEN CAST((y1 - y2) * (y1 - y2) AS DOUBLE) / (y1 + y2) ELSE 0.0::DOUBLE END) * 1000 + 0.5) AS BIGINT) END AS chi FROM segments")
def mth9(spark, d):
    """Chi-squared distance of the end points."""
    part = lambda a, b: F.when(c(a) + c(b) > 0, ((c(a) - c(b)) * (c(a) - c(b))).cast("double") / (c(a) + c(b))).otherwise(F.lit(0.0))
    total = F.floor((part("x1", "x2") + part("y1", "y2")) * 1000 + 0.5).cast("long")
    return V.segments(spark, d).select("img", "id", F.when(c("x1") + c("x2") + c("y1") + c("y2") > 0, total).alias("chi"))


@query("mth12", "segments", "SELECT img, id, least(x1, y1, x2) AS v FROM segments")
def mth12(spark, d):
    return V.segments(spark, d).select("img", "id", F.least("x1", "y1", "x2").alias("v"))


@query("mth2", "", "SELECT p_partkey AS id, pow(2.0::DOUBLE, floor(log2(p_retailprice)) - 52) AS eps FROM part WHERE p_retailprice > 0")
def mth2(spark, d):
    """The spacing of doubles at a value."""
    return V.load(spark, d, "part").where("p_retailprice > 0").select(c("p_partkey").alias("id"), F.pow(F.lit(2.0), F.floor(F.log2("p_retailprice")) - 52).alias("eps"))
