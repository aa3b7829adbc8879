"""The alignment queries over the driver's tables, with the SQL that they match."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqspark.config import CASE_INSENSITIVE, IUPAC, AlignConfig
from seqspark.functions.align import align, alphabet_length, cigar, edit_distance, nice_alignment, path_check, pretty_alignment, with_distance
from seqspark.functions.table import locations, register
from seqspark.operators.join import containment_join, distance_join
from seqspark.operators.search import align_fasta, align_to_target, all_distances, best_targets, n_best, n_best_cli, n_nearest
from seqspark.scratch import scratch
from seqspark.sources.fasta import read_fasta, sequence_stats, write_scores
from seqspark.streaming.align import align_stream, n_best_stream, n_best_window_stream

#: Queries of the infix and prefix searches.
PATTERNS = ("ring", "widgit", "blu bolt", "xyz", "gea", "zzzzzzzzzzzz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def names(spark: SparkSession, sf_dir: str, alias: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_name").alias(alias)).distinct()


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of distinct names: a stated query set against all rows."""
    return names(spark, sf_dir, "q").crossJoin(names(spark, sf_dir, "t"))


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = spark.createDataFrame([(p,) for p in PATTERNS], "q string")
    return names(spark, sf_dir, "t").crossJoin(F.broadcast(queries)).select("q", "t")


def q_nw_distance(spark, sf_dir):
    return pairs(spark, sf_dir).select("q", "t", edit_distance("q", "t").alias("distance"))


def q_nw_kernel(spark, sf_dir):
    return pairs(spark, sf_dir).select("q", "t", edit_distance("q", "t", native=False).alias("distance"))


def q_nw_bounded(spark, sf_dir):
    return pairs(spark, sf_dir).select("q", "t", edit_distance("q", "t", k=3).alias("distance"))


def q_nw_join(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    d = c.toDF("other_key", "other_name")
    return distance_join(c, d, "c_name", "other_name", 1).select("c_custkey", "other_key", "distance")


def q_nw_join_pieces(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    a = p.groupBy(F.col("p_name").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return distance_join(a, a.toDF("other", "m"), "name", "other", 3).select("name", "n", "other", "m", "distance")


def q_join_equalities(spark, sf_dir):
    """Numbers of customers as bases, against the same with ambiguity codes in front: R is A or G, Y is C or T,
    but A isn't G."""
    c = table(spark, sf_dir, "customer").select(F.translate(F.right("c_name", F.lit(9)), "0123456789", "ACGTACGTAC").alias("base"))
    c = c.groupBy("base").agg(F.count(F.lit(1)).alias("n"))
    coded = c.select(F.concat(F.translate(F.left("base", F.lit(6)), "ACGT", "RYRY"), F.right("base", F.lit(3))).alias("code"), F.col("n").alias("m"))
    return distance_join(coded.groupBy("code").agg(F.sum("m").alias("m")), c, "code", "base", 1, equalities=IUPAC).select("code", "m", "base", "n", "distance")


def q_semi_join(spark, sf_dir):
    words = spark.createDataFrame([("small rings",), ("blu bolt",), ("nothing like it",)], "w string")
    return distance_join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), words, "p_name", "w", 2, how="left_semi")


def q_nw_empty(spark, sf_dir):
    t = names(spark, sf_dir, "t").withColumn("q", F.lit(""))
    out = None
    for mode in ("NW", "SHW", "HW"):
        for q, t_ in (("q", "t"), ("t", "q")):
            r = t.select(F.lit(mode).alias("mode"), F.col(q).alias("query"), F.col(t_).alias("target"), align(q, t_, mode=mode, k=1).alias("r"))
            r = r.select("mode", "query", "target", F.col("r.edit_distance").alias("distance"), F.element_at("r.end_locations", 1).alias("end"))
            out = r if out is None else out.union(r)
    return out


def q_hw_distance(spark, sf_dir):
    return searches(spark, sf_dir).select("q", "t", edit_distance("q", "t", mode="HW").alias("distance"))


def q_shw_distance(spark, sf_dir):
    return searches(spark, sf_dir).select("q", "t", edit_distance("q", "t", mode="SHW").alias("distance"))


def q_hw_bounded(spark, sf_dir):
    return searches(spark, sf_dir).select("q", "t", edit_distance("q", "t", mode="HW", k=1).alias("distance"))


def q_hw_ends(spark, sf_dir):
    return locations(searches(spark, sf_dir), "q", "t", mode="HW", task="distance").select("q", "t", "end")


def q_shw_ends(spark, sf_dir):
    return locations(searches(spark, sf_dir), "q", "t", mode="SHW", task="distance").select("q", "t", "end")


def q_hw_locations(spark, sf_dir):
    return locations(searches(spark, sf_dir), "q", "t", mode="HW").select("q", "t", "location_idx", "start", "end")


def q_udtf_locations(spark, sf_dir):
    register(spark)
    searches(spark, sf_dir).createOrReplaceTempView("seqspark_searches")
    return spark.sql("SELECT q, t, l.location_idx, l.start, l.end FROM seqspark_searches, LATERAL seq_locations(q, t) l")


def q_nw_cigar_ext(spark, sf_dir):
    return pairs(spark, sf_dir).select("q", "t", align("q", "t", task="path").getField("cigar").alias("cigar"))


def q_nw_cigar_std(spark, sf_dir):
    return pairs(spark, sf_dir).select("q", "t", align("q", "t", task="path", cigar_format="standard").getField("cigar").alias("cigar"))


def q_cigar_native(spark, sf_dir):
    r = pairs(spark, sf_dir).withColumn("r", align("q", "t", task="path"))
    return r.select("q", "t", cigar("r.alignment").alias("cigar"))


def q_hw_cigar(spark, sf_dir):
    return searches(spark, sf_dir).select("q", "t", align("q", "t", mode="HW", task="path").getField("cigar").alias("cigar"))


def q_nice(spark, sf_dir):
    r = pairs(spark, sf_dir).withColumn("r", align("q", "t", task="path"))
    n = r.select("q", "t", nice_alignment("q", "t", "r").alias("n"))
    return n.select("q", "t", "n.query_aligned", "n.matched_aligned", "n.target_aligned")


def q_equalities(spark, sf_dir):
    up = pairs(spark, sf_dir).withColumn("u", F.upper("q"))
    return up.select("u", "t", edit_distance("u", "t", equalities=CASE_INSENSITIVE).alias("distance"))


def q_alphabet(spark, sf_dir):
    return pairs(spark, sf_dir).select("q", "t", alphabet_length("q", "t").alias("symbols"))


def q_binary(spark, sf_dir):
    b = pairs(spark, sf_dir).withColumns({"bq": F.col("q").cast("binary"), "bt": F.col("t").cast("binary")})
    return b.select("q", "t", edit_distance("bq", "bt", native=False).alias("distance"))


def q_array_symbols(spark, sf_dir):
    """What users did in a week, as arrays of event types (by their first letter's number): the weeks of
    users whose id 20 divides, a stated set, against every week of every other user."""
    e = table(spark, sf_dir, "events").withColumn("week", F.date_trunc("week", "ts").cast("date"))
    seq = e.groupBy("user_id", "week").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: F.ascii(x["event_type"])).alias("seq"))
    seq = seq.select(F.struct("user_id", F.col("week").cast("string").alias("week")).alias("id"), "seq")
    asked, every = seq.where("id.user_id % 20 = 0").toDF("asked", "own"), seq.toDF("other", "seq")
    out = all_distances(asked, every, "asked", "own", "other", "seq").where("asked.user_id <> other.user_id")
    return out.select("asked.user_id", F.col("other.user_id").alias("other_id"), "asked.week", F.col("other.week").alias("other_week"), "distance")


def _scored(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_idx"), F.col("p_name").alias("sequence"))
    target = spark.createDataFrame([("blue widget",)], "sequence string")
    return align_to_target(p, target).select("query_idx", F.col("result.edit_distance").alias("score"))


def q_nbest(spark, sf_dir):
    return n_best(_scored(spark, sf_dir), 10)


def q_nbest_bounded(spark, sf_dir):
    """The parts whose names are nearest to a text, by distances within a bound that some of them gave."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_idx"), F.col("p_name").alias("sequence"))
    target = spark.createDataFrame([("blue widget",)], "sequence string")
    return n_nearest(p, target, 25).select("query_idx", "score")


def q_nbest_cli(spark, sf_dir):
    return n_best_cli(_scored(spark, sf_dir), 10, 8)


def q_containment(spark, sf_dir):
    return containment_join(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "text", "doc_id", "text")


def q_containment_near(spark, sf_dir):
    """Patterns that stand in names with up to a quarter of their characters changed."""
    queries = spark.createDataFrame([(p,) for p in PATTERNS], "q string")
    out = containment_join(queries, names(spark, sf_dir, "t"), "q", "q", "t", "t", k_share=0.25)
    return out.select("q", "t", "k", "distance")


def q_distance_by_brand(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("d", edit_distance("p_name", "p_type"))
    return p.groupBy("p_brand").agg(F.min("d").cast("bigint").alias("least"), F.max("d").cast("bigint").alias("most"), F.sum("d").alias("total"), F.count(F.lit(1)).alias("n"))


def _fasta(spark, sf_dir) -> str:
    path = scratch(spark)
    p = table(spark, sf_dir, "part").select(F.concat(F.lit(">"), F.col("p_partkey").cast("string"), F.lit("\n"), F.substring("p_name", 1, 4), F.lit("\r\n"), F.substring(F.col("p_name"), F.lit(5), F.length("p_name"))).alias("value"))
    p.write.text(path)
    return path


def q_fasta(spark, sf_dir):
    return read_fasta(spark, _fasta(spark, sf_dir)).select(F.col("header").cast("bigint").alias("p_partkey"), "sequence")


def q_fasta_stats(spark, sf_dir):
    return sequence_stats(read_fasta(spark, _fasta(spark, sf_dir)))


def q_align_fasta(spark, sf_dir):
    target = scratch(spark)
    spark.createDataFrame([(">t\nblue widget\n>u\nother",)], "value string").write.text(target)
    out = align_fasta(spark, _fasta(spark, sf_dir), target, mode="HW")
    return out.select(F.col("header").cast("bigint").alias("p_partkey"), "score")


def q_stream(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    stream = spark.readStream.schema(part.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/part.parquet*")
    made = align_stream(stream.withColumn("target", F.lit("blue widget")), "p_name", "target", mode="SHW")
    out = scratch(spark)
    made = made.select("p_partkey", F.col("result.edit_distance").alias("distance"))
    made.writeStream.format("parquet").option("checkpointLocation", out + "-state").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema("p_partkey bigint, distance int").parquet(out)


def q_with_distance(spark, sf_dir):
    """Neighbouring benchmark texts, of any length, in two plans by length; by ASCII
    characters, as the SQL's function counts bytes."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace("text", r"[^\x00-\x7F]", "?").alias("q"))
    shifted = b.select((F.col("item_id") - 1).alias("item_id"), F.col("q").alias("t"))
    return with_distance(b.join(shifted, "item_id"), "q", "t").select("item_id", "distance")


def q_headerless(spark, sf_dir):
    """Records whose file has no header, and one whose text before the first header counts."""
    path = scratch(spark)
    lines = F.concat(F.lit("\n>"), F.col("p_partkey").cast("string"), F.lit("\nAC\r\nGT\n>brand "), F.col("p_brand"), F.lit("\n"), F.col("p_name"), F.lit("\n"))
    first = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) == 1
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.when(first, F.col("p_name")).alias("bare"), lines.alias("rest"))
    p = p.repartition("p_brand").sortWithinPartitions("p_brand", "p_partkey")
    p.select("p_brand", F.concat(F.coalesce("bare", F.lit("")), "rest").alias("value")).write.partitionBy("p_brand").text(path)
    return read_fasta(spark, path).select(F.url_decode(F.url_decode(F.regexp_extract("path", "p_brand=([^/]*)", 1))).alias("brand"), "seq_idx", "header", "sequence")


def q_missing_file(spark, sf_dir):
    """The records of each brand's file, and the error for a brand that has none."""
    path = scratch(spark)
    p = table(spark, sf_dir, "part")
    p.select("p_brand", F.concat(F.lit(">"), F.col("p_partkey").cast("string"), F.lit("\n"), F.col("p_name")).alias("value")).repartition("p_brand").write.partitionBy("p_brand").text(path)
    brand = F.url_decode(F.url_decode(F.regexp_extract("path", "p_brand=([^/]*)", 1)))
    there = read_fasta(spark, path).groupBy(brand.alias("brand")).agg(F.count(F.lit(1)).alias("records"))
    try:
        read_fasta(spark, f"{path}/p_brand=none").count()
        error = "nothing"
    except AnalysisException as e:
        error = e.getCondition()
    missing = spark.createDataFrame([("none", 0, error)], "brand string, records bigint, error string")
    return there.withColumn("error", F.lit(None).cast("string")).unionByName(missing)


def q_score_table(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_idx"), F.col("p_name").alias("sequence"))
    out = scratch(spark)
    write_scores(align_to_target(p, spark.createDataFrame([("blue widget",)], "sequence string"), k=9), out)
    return spark.read.text(out).select(F.col("value").alias("line"))


def q_pretty(spark, sf_dir):
    r = pairs(spark, sf_dir).withColumn("r", align("q", "t", task="path"))
    return r.select("q", "t", pretty_alignment("q", "t", F.col("r")).alias("pretty"))


def q_divided_paths(spark, sf_dir):
    """Paths found by dividing every pair: their cost, and what they take of both texts."""
    r = pairs(spark, sf_dir).select("q", "t", align("q", "t", task="path", path_bytes=1).alias("r"))
    runs = F.regexp_extract_all("r.cigar", F.lit(r"\d+[=XID]"), F.lit(0))
    n = lambda kinds: F.aggregate(F.transform(runs, lambda x: F.when(F.right(x, F.lit(1)).isin(*kinds), F.regexp_extract(x, r"\d+", 0).cast("int")).otherwise(0)), F.lit(0), lambda a, x: a + x)
    return r.select("q", "t", n("XID").alias("cost"), n("=XI").alias("of_query"), n("=XD").alias("of_target"))


def q_iupac(spark, sf_dir):
    """Nucleotide ambiguity codes: N equals each base, in distance, locations and path."""
    t = names(spark, sf_dir, "name").select("name", F.translate(F.upper("name"), "BCDEFGHIJKLMNOPQRSTUVWXYZ ", "CGTACGTACGTACGTACGTACGTACG").alias("t"))
    t = t.withColumn("q", F.repeat(F.lit("N"), F.length("t") - 2))
    return t.select("name", edit_distance("q", "t", equalities=IUPAC).alias("distance"), align("q", "t", mode="SHW", task="path", equalities=IUPAC).getField("cigar").alias("cigar"))


def q_sql_functions(spark, sf_dir):
    register(spark)
    pairs(spark, sf_dir).createOrReplaceTempView("seqspark_pairs")
    return spark.sql(
        "SELECT q, t, seq_distance(q, t, 'NW', -1) AS distance, r.cigar AS cigar, seq_cigar(r.alignment, 'standard') AS standard, n.matched_aligned AS matched "
        "FROM (SELECT q, t, seq_align(q, t, 'NW', 'path', -1) AS r, seq_nice(q, t, 'NW') AS n FROM seqspark_pairs)"
    )


def q_align_fasta_pretty(spark, sf_dir):
    target = scratch(spark)
    spark.createDataFrame([(">t\nblue widget",)], "value string").write.text(target)
    out = align_fasta(spark, _fasta(spark, sf_dir), target, task="path", pretty=True)
    return out.select(F.col("header").cast("bigint").alias("p_partkey"), "score", "pretty")


def q_align_fasta_nice(spark, sf_dir):
    target = scratch(spark)
    spark.createDataFrame([(">t\nblue widget",)], "value string").write.text(target)
    out = align_fasta(spark, _fasta(spark, sf_dir), target, task="path", nice=True)
    return out.select(F.col("header").cast("bigint").alias("p_partkey"), "nice.query_aligned", "nice.matched_aligned", "nice.target_aligned")


def q_nbest_stream(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    stream = spark.readStream.schema(part.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/part.parquet*")
    scored = stream.withColumn("distance", edit_distance("p_name", F.lit("blue widget"))).withColumn("item", F.lpad(F.col("p_partkey").cast("string"), 12, "0"))
    out = scratch(spark)
    best = n_best_stream(scored, "p_brand", "distance", "item", 3)
    write = lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(out)
    best.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", out + "-state").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(out).groupBy("p_brand").agg(F.max_by(F.struct("items", "scores"), "batch").alias("m"))
    return last.select("p_brand", F.array_join("m.items", ",").alias("items"), F.array_join(F.col("m.scores").cast("array<string>"), ",").alias("scores"))


def q_nbest_window_stream(spark, sf_dir):
    """For each event type and quarter of a day, once its time is over, the events whose user number is nearest to a text."""
    e = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(e.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    scored = stream.withColumn("distance", edit_distance(F.col("user_id").cast("string"), F.lit("777"), native=True)).withColumn("item", F.lpad(F.col("event_id").cast("string"), 12, "0"))
    out, key = scratch(spark), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        best = n_best_window_stream(scored, "event_type", "ts", "distance", "item", 3, "6 hours")
        best.writeStream.outputMode("append").option("checkpointLocation", out + "-state").trigger(availableNow=True).format("parquet").start(out).awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.parquet(out).select("event_type", F.col("until").cast("string").alias("until"), F.array_join("items", ",").alias("items"), F.array_join(F.col("scores").cast("array<string>"), ",").alias("scores"))


def q_settings(spark, sf_dir):
    """What the settings do to a pair: by default, all stated, a null bound, bounds one below and at the distance."""
    c = AlignConfig()
    r = pairs(spark, sf_dir).select("q", "t", align("q", "t").alias("r"), align("q", "t", mode=c.mode, task=c.task, k=c.k, equalities=c.equalities).alias("s"), align("q", "t", k=None, task="locations").alias("u"))
    bounded = lambda k: edit_distance("q", "t", k=k, native=False)
    return r.select("q", "t", F.col("r.edit_distance").alias("distance"), F.col("s.edit_distance").alias("stated"), F.col("u.edit_distance").alias("unbounded"), F.col("r.start_locations").isNull().alias("no_starts"), F.element_at("u.start_locations", 1).alias("start"), bounded(6).alias("within_6"), bounded(7).alias("within_7"))


def q_path_checks(spark, sf_dir):
    """Paths of all three modes, walked: sound, as dear as the distance says, from the reported start on, and
    none inserts at first where a mismatch could stand."""
    out = None
    for mode, of in (("NW", pairs), ("SHW", searches), ("HW", searches)):
        r = of(spark, sf_dir).withColumn("r", align("q", "t", mode=mode, task="path"))
        r = r.withColumn("c", path_check("q", "t", F.col("r"), mode)).where("c is not null")
        r = r.select(F.lit(mode).alias("mode"), "q", "t", "c.sound", "c.cost", (F.col("c.start") == F.element_at("r.start_locations", 1)).alias("from_start"), F.col("c.starts_by_insertion").alias("starts_by_insertion"))
        out = r if out is None else out.unionByName(r)
    return out


def q_best_targets(spark, sf_dir):
    """The parts in whose names each of a stated set of patterns is found best, with all ties."""
    asked = spark.createDataFrame([(p,) for p in PATTERNS], "q string")
    return best_targets(asked, table(spark, sf_dir, "part"), "q", "q", "p_partkey", "p_name", mode="HW")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for k, f in list(globals().items()) if k.startswith("q_")}

_P = "(SELECT DISTINCT p_name AS q FROM part) a, (SELECT DISTINCT p_name AS t FROM part) b"
_S = "(SELECT unnest([" + ", ".join(f"'{p}'" for p in PATTERNS) + "]) AS q) a, (SELECT DISTINCT p_name AS t FROM part) b"
#: score of the whole query against the best part of the target that ends at e
_ENDS = {
    "HW": f"SELECT q, t, e, min(levenshtein(q, substr(t, s, e - s + 1))) AS d FROM (SELECT q, t, e, unnest(range(1, e + 2)) AS s FROM (SELECT q, t, unnest(range(1, length(t) + 1)) AS e FROM {_S})) GROUP BY ALL",
    "SHW": f"SELECT q, t, e, levenshtein(q, left(t, e)) AS d FROM (SELECT q, t, unnest(range(1, length(t) + 1)) AS e FROM {_S})",
}
_BEST = {m: f"SELECT q, t, e, d FROM ({s}) QUALIFY d = min(d) OVER (PARTITION BY q, t)" for m, s in _ENDS.items()}
_LOCATED = {m: f"SELECT q, t, CAST(e - 1 AS INT) AS \"end\", d FROM ({s}) UNION ALL SELECT DISTINCT q, t, -1, d FROM ({s}) WHERE d = length(q) AND length(q) % 64 <> 0" for m, s in _BEST.items()}
_STARTS = f"""SELECT q, t, "end", d, CASE WHEN "end" < 0 THEN 0 ELSE (SELECT min(s) FROM (SELECT unnest(range(0, "end" + 2)) AS s) WHERE levenshtein(q, substr(t, CAST(s AS INT) + 1, CAST("end" - s + 1 AS INT))) = d) END AS start FROM ({_LOCATED["HW"]})"""
_LOCATIONS = f"""SELECT q, t, CAST(row_number() OVER (PARTITION BY q, t ORDER BY "end") - 1 AS INT) AS location_idx, CAST(start AS INT) AS start, "end" FROM ({_STARTS})"""


def _paths(source: str) -> str:
    """Operations, and the two texts with gaps, of each (k, q, t): back from the end, insertion before deletion before diagonal."""
    return f"""WITH RECURSIVE src AS MATERIALIZED ({source}), tb AS (
      SELECT k, q, t, CAST(length(q) AS INT) AS i, CAST(length(t) AS INT) AS j, '' AS ops, '' AS qa, '' AS ta FROM src
      UNION ALL
      SELECT k, q, t, CASE WHEN op = 'D' THEN i ELSE i - 1 END, CASE WHEN op = 'I' THEN j ELSE j - 1 END, op || ops,
             CASE WHEN op = 'D' THEN '-' ELSE substr(q, i, 1) END || qa, CASE WHEN op = 'I' THEN '-' ELSE substr(t, j, 1) END || ta
      FROM (SELECT *, CASE WHEN i > 0 AND levenshtein(left(q, i - 1), left(t, j)) + 1 = levenshtein(left(q, i), left(t, j)) THEN 'I'
                           WHEN j > 0 AND levenshtein(left(q, i), left(t, j - 1)) + 1 = levenshtein(left(q, i), left(t, j)) THEN 'D'
                           WHEN substr(q, i, 1) = substr(t, j, 1) THEN '=' ELSE 'X' END AS op FROM tb WHERE i > 0 OR j > 0))
      SELECT k, q, t, ops, qa, ta FROM tb WHERE i = 0 AND j = 0"""


def _rle(ops: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({ops}, '=+|X+|I+|D+|M+'), lambda x: length(x) || left(x, 1)), '')"


def _pretty(q: str, t: str) -> str:
    """The one block of an alignment of fifty columns or fewer."""
    return f"'T: ' || ta || ' (0 - ' || (length({t}) - 1) || ')' || chr(10) || '   ' || translate(ops, '=XID', '|   ') || chr(10) || 'Q: ' || qa || ' (0 - ' || (length({q}) - 1) || ')' || chr(10)"


_FASTA_PATHS = _paths("SELECT p_partkey AS k, p_name AS q, 'blue widget' AS t FROM part")
_NW_PATHS = _paths(f"SELECT t AS k, q, t FROM {_P}")
_HW_PATHS = _paths(f"""SELECT t AS k, q, substr(t, CAST(start AS INT) + 1, CAST("end" - start + 1 AS INT)) AS t FROM ({_STARTS}) QUALIFY row_number() OVER (PARTITION BY q, t ORDER BY "end") = 1""")
_SCORES = "SELECT p_partkey AS query_idx, CAST(levenshtein(p_name, 'blue widget') AS INT) AS score FROM part"

ORACLE_SQL: dict[str, str] = {
    "q_nw_distance": f"SELECT q, t, CAST(levenshtein(q, t) AS INT) AS distance FROM {_P}",
    "q_nw_kernel": f"SELECT q, t, CAST(levenshtein(q, t) AS INT) AS distance FROM {_P}",
    "q_binary": f"SELECT q, t, CAST(levenshtein(q, t) AS INT) AS distance FROM {_P}",
    "q_nw_bounded": f"SELECT q, t, CAST(CASE WHEN levenshtein(q, t) > 3 THEN -1 ELSE levenshtein(q, t) END AS INT) AS distance FROM {_P}",
    "q_nw_join": "SELECT a.c_custkey, b.c_custkey AS other_key, CAST(levenshtein(a.c_name, b.c_name) AS INT) AS distance FROM customer a, customer b WHERE levenshtein(a.c_name, b.c_name) <= 1",
    "q_nw_join_pieces": "WITH n AS (SELECT p_name AS name, count(*) AS n FROM part GROUP BY 1) SELECT a.name, a.n, b.name AS other, b.n AS m, CAST(levenshtein(a.name, b.name) AS INT) AS distance FROM n a, n b WHERE levenshtein(a.name, b.name) <= 3",
    "q_join_equalities": "WITH c AS (SELECT translate(right(c_name, 9), '0123456789', 'ACGTACGTAC') AS base, count(*) AS n FROM customer GROUP BY 1), d AS (SELECT translate(left(base, 6), 'ACGT', 'RYRY') || right(base, 3) AS code, CAST(sum(n) AS BIGINT) AS m FROM c GROUP BY 1), "
    # how a code with three bases at the end meets bases: three tails, each taken apart from its head
    "s AS (SELECT code, m, base, n, left(code, 6) AS h, right(code, 3) AS t FROM d, c), "
    "e AS (SELECT code, m, base, n, min(levenshtein(h, translate(left(base, i), 'ACGT', 'RYRY')) + levenshtein(t, substr(base, i + 1))) AS d FROM s, (SELECT CAST(unnest(range(4, 9)) AS BIGINT) AS i) GROUP BY ALL) "
    "SELECT code, m, base, n, CAST(d AS INT) AS distance FROM e WHERE d <= 1",
    "q_semi_join": "SELECT p_partkey, p_name FROM part WHERE least(levenshtein(p_name, 'small rings'), levenshtein(p_name, 'blu bolt'), levenshtein(p_name, 'nothing like it')) <= 2",
    "q_nw_empty": "WITH n AS (SELECT DISTINCT p_name AS t FROM part), m AS (SELECT unnest(['NW', 'SHW', 'HW']) AS mode) SELECT mode, '' AS query, t AS target, CAST(CASE WHEN mode = 'NW' THEN length(t) ELSE 0 END AS INT) AS distance, CAST(CASE WHEN mode = 'NW' THEN length(t) - 1 ELSE -1 END AS INT) AS \"end\" FROM n, m UNION ALL SELECT mode, t, '', CAST(length(t) AS INT), -1 FROM n, m",
    "q_hw_distance": f"SELECT q, t, CAST(min(d) AS INT) AS distance FROM ({_ENDS['HW']}) GROUP BY q, t",
    "q_shw_distance": f"SELECT q, t, CAST(min(d) AS INT) AS distance FROM ({_ENDS['SHW']}) GROUP BY q, t",
    "q_hw_bounded": f"SELECT q, t, CAST(CASE WHEN min(d) > 1 THEN -1 ELSE min(d) END AS INT) AS distance FROM ({_ENDS['HW']}) GROUP BY q, t",
    "q_hw_ends": f'SELECT q, t, "end" FROM ({_LOCATED["HW"]})',
    "q_shw_ends": f'SELECT q, t, "end" FROM ({_LOCATED["SHW"]})',
    "q_hw_locations": _LOCATIONS,
    "q_udtf_locations": _LOCATIONS,
    "q_nw_cigar_ext": f"SELECT q, t, {_rle('ops')} AS cigar FROM ({_NW_PATHS})",
    "q_cigar_native": f"SELECT q, t, {_rle('ops')} AS cigar FROM ({_NW_PATHS})",
    "q_nw_cigar_std": "SELECT q, t, " + _rle("replace(replace(ops, '=', 'M'), 'X', 'M')") + f" AS cigar FROM ({_NW_PATHS})",
    "q_hw_cigar": f"SELECT q, k AS t, {_rle('ops')} AS cigar FROM ({_HW_PATHS})",
    "q_nice": f"SELECT q, t, qa AS query_aligned, translate(ops, '=XID', '|.--') AS matched_aligned, ta AS target_aligned FROM ({_NW_PATHS})",
    "q_equalities": f"SELECT upper(q) AS u, t, CAST(levenshtein(lower(q), lower(t)) AS INT) AS distance FROM {_P}",
    "q_alphabet": f"SELECT q, t, CAST(length(list_distinct(list_concat(string_split(q, ''), string_split(t, '')))) AS INT) AS symbols FROM {_P}",
    "q_array_symbols": "WITH s AS (SELECT user_id, CAST(date_trunc('week', ts) AS DATE) AS week, string_agg(CASE event_type WHEN 'view' THEN 'v' WHEN 'click' THEN 'c' WHEN 'signup' THEN 's' WHEN 'error' THEN 'e' ELSE 'p' END, '' ORDER BY ts, event_id) AS seq FROM events GROUP BY 1, 2) SELECT a.user_id, b.user_id AS other_id, CAST(a.week AS VARCHAR) AS week, CAST(b.week AS VARCHAR) AS other_week, CAST(levenshtein(a.seq, b.seq) AS INT) AS distance FROM s a JOIN s b ON a.user_id % 20 = 0 AND a.user_id <> b.user_id",
    "q_with_distance": r"WITH x AS (SELECT item_id, regexp_replace(text, '[^\x00-\x7F]', '?', 'g') AS text FROM benchmark) SELECT a.item_id, CAST(levenshtein(a.text, b.text) AS INT) AS distance FROM x a JOIN x b ON b.item_id = a.item_id + 1",
    "q_headerless": "WITH p AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part) SELECT p_brand AS brand, CAST(CASE WHEN i = 0 THEN 0 ELSE 2 * k - 2 + i END AS INT) AS seq_idx, CASE i WHEN 1 THEN CAST(p_partkey AS VARCHAR) WHEN 2 THEN 'brand ' || p_brand END AS header, CASE WHEN i = 1 THEN 'ACGT' ELSE p_name END AS sequence FROM p, (SELECT unnest([0, 1, 2]) AS i) WHERE i > 0 OR k = 1",
    "q_missing_file": "SELECT p_brand AS brand, count(*) AS records, CAST(NULL AS VARCHAR) AS error FROM part GROUP BY 1 UNION ALL SELECT 'none', 0, 'PATH_NOT_FOUND'",
    "q_path_checks": f"SELECT 'NW' AS mode, q, t, true AS sound, CAST(levenshtein(q, t) AS INT) AS cost, true AS from_start, false AS starts_by_insertion FROM {_P} UNION ALL "
    + " UNION ALL ".join(f"SELECT '{m}', q, t, true, CAST(min(d) AS INT), true, false FROM ({_ENDS[m]}) GROUP BY q, t" for m in ("SHW", "HW")),
    "q_best_targets": f"WITH d AS (SELECT q, t, CAST(min(d) AS INT) AS distance FROM ({_ENDS['HW']}) GROUP BY q, t), m AS (SELECT q, min(distance) AS distance FROM d GROUP BY q) SELECT q, p_partkey, distance FROM d JOIN m USING (q, distance) JOIN part ON p_name = t",
    "q_score_table": f"SELECT '#' || query_idx || ': ' || score || '  1 [ (?, 10) ]' AS line FROM ({_SCORES}) WHERE score <= 9",
    "q_pretty": f"SELECT q, t, {_pretty('q', 't')} AS pretty FROM ({_NW_PATHS})",
    "q_divided_paths": f"SELECT q, t, CAST(levenshtein(q, t) AS INT) AS cost, CAST(length(q) AS INT) AS of_query, CAST(length(t) AS INT) AS of_target FROM {_P}",
    "q_iupac": "SELECT DISTINCT p_name AS name, 2 AS distance, (length(p_name) - 2) || '=' AS cigar FROM part",
    "q_sql_functions": f"SELECT q, t, CAST(levenshtein(q, t) AS INT) AS distance, {_rle('ops')} AS cigar, " + _rle("replace(replace(ops, '=', 'M'), 'X', 'M')") + f" AS standard, translate(ops, '=XID', '|.--') AS matched FROM ({_NW_PATHS})",
    "q_align_fasta_pretty": f"SELECT k AS p_partkey, CAST(levenshtein(q, t) AS INT) AS score, {_pretty('q', 't')} AS pretty FROM ({_FASTA_PATHS})",
    "q_align_fasta_nice": f"SELECT k AS p_partkey, qa AS query_aligned, translate(ops, '=XID', '|.--') AS matched_aligned, ta AS target_aligned FROM ({_FASTA_PATHS})",
    "q_nbest_stream": "SELECT p_brand, string_agg(lpad(CAST(p_partkey AS VARCHAR), 12, '0'), ',' ORDER BY d, p_partkey) AS items, string_agg(CAST(d AS VARCHAR), ',' ORDER BY d, p_partkey) AS scores FROM (SELECT *, levenshtein(p_name, 'blue widget') AS d FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY d, p_partkey) <= 3) GROUP BY 1",
    "q_nbest_window_stream": "WITH e AS (SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR AS until, lpad(CAST(event_id AS VARCHAR), 12, '0') AS item, CAST(levenshtein(CAST(user_id AS VARCHAR), '777') AS INT) AS d FROM events), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY event_type, until ORDER BY d, item) AS k FROM e WHERE until < (SELECT max(ts) - INTERVAL 1 HOUR FROM events)) "
    "SELECT event_type, CAST(until AS VARCHAR) AS until, string_agg(item, ',' ORDER BY k) AS items, string_agg(CAST(d AS VARCHAR), ',' ORDER BY k) AS scores FROM r WHERE k <= 3 GROUP BY 1, 2",
    "q_settings": f"SELECT q, t, d AS distance, d AS stated, d AS unbounded, true AS no_starts, 0 AS start, CASE WHEN d <= 6 THEN d ELSE -1 END AS within_6, CASE WHEN d <= 7 THEN d ELSE -1 END AS within_7 FROM (SELECT q, t, CAST(levenshtein(q, t) AS INT) AS d FROM {_P})",
    "q_nbest": f"SELECT query_idx, score FROM ({_SCORES}) ORDER BY score, query_idx LIMIT 10",
    "q_nbest_bounded": f"SELECT query_idx, score FROM ({_SCORES}) ORDER BY score, query_idx LIMIT 25",
    "q_nbest_cli": f"WITH s AS (SELECT * FROM ({_SCORES}) WHERE score <= 8), l AS (SELECT max(score) AS top FROM (SELECT score FROM s ORDER BY score LIMIT 10)) SELECT query_idx, score FROM s, l WHERE score <= top AND (score = 0 OR (SELECT count(*) FROM s o WHERE o.query_idx < s.query_idx AND o.score <= s.score) < 10)",
    "q_containment": "SELECT item_id, doc_id, CAST(floor(length(b.text) * 0.05) AS INT) AS k, 0 AS distance FROM benchmark b, documents d WHERE contains(d.text, b.text)",
    "q_containment_near": f"SELECT q, t, CAST(floor(length(q) * 0.25) AS INT) AS k, CAST(least(length(q), min(d)) AS INT) AS distance FROM ({_ENDS['HW']}) GROUP BY q, t HAVING least(length(q), min(d)) <= floor(length(q) * 0.25)",
    "q_distance_by_brand": "SELECT p_brand, min(levenshtein(p_name, p_type)) AS least, max(levenshtein(p_name, p_type)) AS most, CAST(sum(levenshtein(p_name, p_type)) AS BIGINT) AS total, count(*) AS n FROM part GROUP BY 1",
    "q_fasta": "SELECT p_partkey, p_name AS sequence FROM part",
    "q_fasta_stats": "SELECT count(*) AS n_records, CAST(sum(length(p_name)) AS BIGINT) AS n_residues FROM part",
    "q_align_fasta": "SELECT p_partkey, (SELECT CAST(min(levenshtein(p_name, substr('blue widget', s, e - s + 1))) AS INT) FROM (SELECT unnest(range(1, 13)) AS s), (SELECT unnest(range(0, 12)) AS e) WHERE e >= s - 1) AS score FROM part",
    "q_stream": "SELECT p_partkey, (SELECT CAST(min(levenshtein(p_name, left('blue widget', e))) AS INT) FROM (SELECT unnest(range(1, 12)) AS e)) AS distance FROM part",
}
