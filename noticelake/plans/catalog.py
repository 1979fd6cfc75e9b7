"""Queries on the source catalog and on driver dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import worklist as W
from .register import query

CATALOG = """WITH p AS (SELECT l.municipality_id, s.name AS primary_name, s.source_kind, s.canonical_url FROM cat_link l JOIN cat_source s USING (source_id) WHERE relation_type = 'primary'),
x AS (SELECT municipality_id, count(DISTINCT source_id) AS supplements, string_agg(DISTINCT s.name, ' | ' ORDER BY s.name) AS supplement_names FROM cat_link l JOIN cat_source s USING (source_id) WHERE relation_type = 'supplemental' GROUP BY 1),
c AS (SELECT n_nationkey AS municipality_id, n_name AS municipality, primary_name, source_kind, canonical_url, coalesce(supplements, 0) AS supplements, coalesce(supplement_names, '') AS supplement_names, rating, uncertain
 FROM nation LEFT JOIN p ON p.municipality_id = n_nationkey LEFT JOIN x ON x.municipality_id = n_nationkey LEFT JOIN cat_quality q ON q.municipality_id = n_nationkey)"""
CV = ("cat_link", "cat_source", "cat_quality")


def catalog(t):
    towns = t.nation.select(F.col("n_nationkey").alias("municipality_id"), F.col("n_name").alias("municipality"))
    return C.catalog(towns, t.cat_link, t.cat_source, t.cat_quality)


@query("e1_catalog", CATALOG + " SELECT municipality_id, municipality, primary_name, source_kind, supplements, rating FROM c", *CV)
def e1(t):
    return catalog(t).select("municipality_id", "municipality", "primary_name", "source_kind", "supplements", "rating")


@query("e6_supplement_names", CATALOG + " SELECT municipality_id, supplement_names FROM c", *CV)
def e6(t):
    return catalog(t).select("municipality_id", "supplement_names")


@query("c5_export_rows", CATALOG + " SELECT municipality AS name, CASE WHEN uncertain THEN 'ja' ELSE 'nein' END AS uncertain, coalesce(primary_name || ' (' || source_kind || ')', '') AS source FROM c", *CV)
def c5(t):
    return catalog(t).select(
        F.col("municipality").alias("name"), F.when(F.coalesce("uncertain", F.lit(False)), "ja").otherwise("nein").alias("uncertain"),
        F.coalesce(F.concat("primary_name", F.lit(" ("), "source_kind", F.lit(")")), F.lit("")).alias("source"),
    )


@query("b2_json_export", CATALOG + " SELECT municipality_id, municipality, supplements FROM c", *CV)
def b2(t):
    rows = catalog(t).select(F.to_json(F.struct("municipality_id", "municipality", "supplements")).alias("j"))
    return rows.select(F.from_json("j", "municipality_id int, municipality string, supplements long").alias("r")).select("r.*")


@query("f4_shared_sources", "SELECT source_id, name, count(DISTINCT municipality_id) AS municipalities FROM cat_link JOIN cat_source USING (source_id) GROUP BY 1, 2 HAVING count(DISTINCT municipality_id) > 1", *CV)
def f4(t):
    return C.shared_sources(t.cat_link, t.cat_source)


@query("f5_coverage_report", "SELECT count(*) FILTER (rating = 'A') AS rating_a, count(*) FILTER (rating = 'B') AS rating_b, count(*) FILTER (rating = 'C') AS rating_c, count(*) FILTER (rating = 'D') AS rating_d, count(*) FILTER (uncertain) AS uncertain, count(*) AS total FROM cat_quality", *CV)
def f5(t):
    return C.rating_report(t.cat_quality)


@query("is2_union_distinct", "SELECT count(*) AS n FROM (SELECT municipality_id FROM cat_link WHERE relation_type = 'primary' UNION SELECT municipality_id FROM cat_quality WHERE uncertain)", *CV)
def is2(t):
    a = t.cat_link.filter("relation_type = 'primary'").select("municipality_id")
    return a.union(t.cat_quality.filter("uncertain").select("municipality_id")).distinct().agg(F.count(F.lit(1)).alias("n"))


@query("f14_audit_summary", "SELECT s.source_kind, q.rating, count(*) AS n, count(*) FILTER (uncertain) AS needs_review FROM cat_quality q JOIN cat_source s ON s.source_id = q.primary_source_id GROUP BY 1, 2", *CV)
def f14(t):
    rows = t.cat_quality.join(t.cat_source, F.col("primary_source_id") == F.col("source_id"))
    return rows.groupBy("source_kind", "rating").agg(F.count(F.lit(1)).alias("n"), F.count_if("uncertain").alias("needs_review"))


@query("f19_source_kpis", "SELECT greatest(count(*) FILTER (uncertain), count(*) FILTER (rating = 'D'), count(*) FILTER (rating = 'C')) AS maintenance, round(100.0 * count(*) FILTER (rating IN ('A', 'B')) / count(*), 1)::DOUBLE AS percent, CASE WHEN count(*) FILTER (rating IN ('A', 'B')) * 2 >= count(*) THEN 'good' ELSE 'weak' END AS label FROM cat_quality", *CV)
def f19(t):
    good = F.count_if(F.col("rating").isin("A", "B"))
    return t.cat_quality.agg(
        F.greatest(F.count_if("uncertain"), F.count_if(F.col("rating") == "D"), F.count_if(F.col("rating") == "C")).alias("maintenance"),
        F.round(100.0 * good / F.count(F.lit(1)), 1).alias("percent"), F.when(good * 2 >= F.count(F.lit(1)), "good").otherwise("weak").alias("label"),
    )


@query("e4_link_audit", "SELECT n.n_name AS municipality, s.name, l.relation_type, q.rating FROM cat_link l JOIN nation n ON n.n_nationkey = l.municipality_id JOIN cat_source s USING (source_id) LEFT JOIN cat_quality q ON q.municipality_id = l.municipality_id AND q.primary_source_id = l.source_id", *CV)
def e4(t):
    q = t.cat_quality.select("municipality_id", F.col("primary_source_id").alias("source_id"), "rating")
    rows = t.cat_link.join(t.nation, F.col("n_nationkey") == F.col("municipality_id")).join(t.cat_source, "source_id").join(q, ["municipality_id", "source_id"], "left")
    return rows.select(F.col("n_name").alias("municipality"), "name", "relation_type", "rating").orderBy("municipality", "relation_type", "name")


@query("e26_catalog_hits", "SELECT n.n_nationkey AS municipality_id, coalesce(h.hits, 0) AS hits FROM nation n LEFT JOIN (SELECT municipality, count(*) AS hits FROM app WHERE protection_status <> 'no-hit' GROUP BY 1) h ON h.municipality = 'Town ' || n.n_nationkey", "app")
def e26(t):
    hits = t.app.filter("protection_status <> 'no-hit'").groupBy("municipality").agg(F.count(F.lit(1)).alias("hits"))
    towns = t.nation.select(F.col("n_nationkey").alias("municipality_id"), F.concat(F.lit("Town "), F.col("n_nationkey").cast("string")).alias("municipality"))
    return towns.join(hits, "municipality", "left").select("municipality_id", F.coalesce("hits", F.lit(0)).alias("hits"))


@query("e27_parent_children", "SELECT municipality_id, len(list(source_id)) AS children, coalesce(min(source_id) FILTER (relation_type = 'primary'), min(source_id)) AS pick FROM cat_link GROUP BY 1", *CV)
def e27(t):
    kids = t.cat_link.groupBy("municipality_id").agg(F.array_sort(F.collect_list(F.struct("source_id", "relation_type"))).alias("kids"))
    first = F.try_element_at(F.filter("kids", lambda k: k["relation_type"] == "primary"), F.lit(1))
    return kids.select("municipality_id", F.size("kids").alias("children"), F.coalesce(first["source_id"], F.col("kids")[0]["source_id"]).alias("pick"))


@query("a17_configured_sources", "SELECT source_id, name, source_kind = 'municipality-direct' AS prune_stale FROM cat_source WHERE canonical_url <> '' AND source_kind <> 'manual'", *CV)
def a17(t):
    rows = t.cat_source.filter("canonical_url <> '' and source_kind <> 'manual'")
    return rows.select("source_id", "name", (F.col("source_kind") == "municipality-direct").alias("prune_stale"))


@query("a18_dimensions", "SELECT n_name AS municipality, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def a18(t):
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("municipality"), F.col("r_name").alias("region"))


@query("e24_region_lookup", "SELECT c_custkey, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON lower(r_name) = lower(r_name) AND r_regionkey = n_regionkey")
def e24(t):
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("r_regionkey") == F.col("n_regionkey"), "left").select("c_custkey", F.col("r_name").alias("region"))


@query("e2_comments_with_author", "SELECT o_orderkey, c_name, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM orders JOIN customer ON o_custkey = c_custkey")
def e2(t):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", F.row_number().over(w).alias("place"))


@query("e3_role_playing", "SELECT o_orderkey, a.n_name AS created_in, b.n_name AS used_in FROM orders LEFT JOIN nation a ON a.n_nationkey = o_custkey % 30 LEFT JOIN nation b ON b.n_nationkey = o_orderkey % 30")
def e3(t):
    a, b = t.nation.select(F.col("n_nationkey").alias("ka"), F.col("n_name").alias("created_in")), t.nation.select(F.col("n_nationkey").alias("kb"), F.col("n_name").alias("used_in"))
    return t.orders.join(a, F.col("ka") == F.col("o_custkey") % 30, "left").join(b, F.col("kb") == F.col("o_orderkey") % 30, "left").select("o_orderkey", "created_in", "used_in")


@query("e5_correlated_count", "SELECT o_orderkey, (SELECT count(DISTINCT l_suppkey) FROM lineitem WHERE l_orderkey = o_orderkey) AS suppliers FROM orders")
def e5(t):
    n = t.lineitem.groupBy("l_orderkey").agg(F.count_distinct("l_suppkey").alias("suppliers"))
    return t.orders.join(n, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query("e7_child_counts", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders, (SELECT count(*) FROM events WHERE user_id = c_custkey) AS reads FROM customer")
def e7(t):
    o, r = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders")), t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("reads"))
    rows = t.customer.join(o, F.col("o_custkey") == F.col("c_custkey"), "left").join(r, F.col("user_id") == F.col("c_custkey"), "left")
    return rows.select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("reads", F.lit(0)).alias("reads"))


@query("e8_anti_join", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def e8(t):
    return t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("o_orderkey")


@query("e9_semi_join", "SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) AS large FROM orders")
def e9(t):
    big = t.lineitem.filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("large", F.lit(True))
    return t.orders.join(big, "o_orderkey", "left").select("o_orderkey", F.coalesce("large", F.lit(False)).alias("large"))


@query("e10_read_flag", "SELECT c_custkey, EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND event_type = (SELECT min(event_type) FROM events)) AS is_read FROM customer")
def e10(t):
    kind = t.events.agg(F.min("event_type").alias("event_type"))
    seen = t.events.join(F.broadcast(kind), "event_type").select(F.col("user_id").alias("c_custkey")).distinct().withColumn("r", F.lit(True))
    return t.customer.join(seen, "c_custkey", "left").select("c_custkey", F.col("r").isNotNull().alias("is_read"))


@query("f0_conditional_summary", "SELECT count(*) AS n, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS b, count(*) FILTER (l_quantity > 25) AS large, count(*) FILTER (l_discount > 0.05) AS discounted, count(*) FILTER (l_linestatus = 'O') AS open FROM lineitem")
def f0(t):
    return t.lineitem.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "A").alias("a"), F.count_if(F.col("l_returnflag") == "N").alias("b"),
        F.count_if(F.col("l_quantity") > 25).alias("large"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"), F.count_if(F.col("l_linestatus") == "O").alias("open"),
    )


@query("b1_csv_export", CATALOG + " SELECT municipality, supplement_names FROM c", *CV)
def b1(t):
    from ..sources.work import work_path

    rows = catalog(t).select("municipality", "supplement_names")
    path = work_path(t.spark, "csv")
    rows.write.csv(path, header=True, quote='"', escape='"', emptyValue="")
    return t.spark.read.schema(rows.schema).csv(path, header=True, quote='"', escape='"').select("municipality", F.coalesce("supplement_names", F.lit("")).alias("supplement_names"))


@query("b3_audit_report", "SELECT 'summary' AS part, count(*) AS n FROM cat_quality UNION ALL SELECT 'municipality', count(*) FROM nation UNION ALL SELECT 'link', count(*) FROM cat_link", *CV)
def b3(t):
    from ..sources.work import work_path

    path = work_path(t.spark, "audit")
    parts = [("summary", t.cat_quality), ("municipality", t.nation), ("link", t.cat_link)]
    for name, df in parts:
        df.select(F.to_json(F.struct("*")).alias("row")).withColumn("part", F.lit(name)).write.mode("append").partitionBy("part").json(path)
    return t.spark.read.schema("row string, part string").json(path).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("b4_audit_sink", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def b4(t):
    from ..sources.work import work_path

    path = work_path(t.spark, "events")
    rows = t.events.select("event_id", "ts", F.to_date("ts").alias("day"))
    rows.write.mode("append").partitionBy("day").parquet(path)
    return W.newest(t.spark.read.schema(rows.schema).parquet(path), [F.desc("ts"), F.desc("event_id")], 50).select("event_id")


@query("j13_dimension_upsert", "SELECT coalesce(o.k, n.k) AS k, coalesce(n.name, o.name) AS name, coalesce(o.token, n.token) AS token FROM (SELECT n_nationkey AS k, n_name AS name, 'old' AS token FROM nation WHERE n_nationkey < 15) o FULL JOIN (SELECT n_nationkey AS k, lower(n_name) AS name, 'new' AS token FROM nation WHERE n_nationkey > 10) n ON o.k = n.k")
def j13(t):
    old = t.nation.filter("n_nationkey < 15").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.lit("old").alias("token"))
    new = t.nation.filter("n_nationkey > 10").select(F.col("n_nationkey").alias("k"), F.lower("n_name").alias("name"), F.lit("new").alias("token"))
    return C.upsert_dimension(old, new, "k", keep=["token"])


@query("j12_seed_upsert", "SELECT s_suppkey AS k, CASE WHEN s_acctbal < 0 AND s_name <> upper(s_name) THEN upper(s_name) ELSE s_name END AS name FROM supplier")
def j12(t):
    seed = t.supplier.select("s_suppkey", F.upper("s_name").alias("seed_name"))
    rows = t.supplier.join(seed, "s_suppkey", "left")
    blank = (F.col("s_acctbal") < 0) & (F.col("s_name") != F.col("seed_name"))
    return rows.select(F.col("s_suppkey").alias("k"), F.when(blank, F.col("seed_name")).otherwise(F.col("s_name")).alias("name"))


@query("j14_catalog_build", "SELECT 'source' AS part, count(DISTINCT s_nationkey) AS n FROM supplier UNION ALL SELECT 'link', count(*) FROM supplier UNION ALL SELECT 'municipality', count(*) FROM nation")
def j14(t):
    sources = W.first_per_key(t.supplier.select(F.col("s_nationkey").alias("source_key"), "s_suppkey", "s_name"), ["source_key"], ["s_suppkey"])
    parts = [("source", sources), ("link", t.supplier), ("municipality", t.nation)]
    counted = [df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n")) for name, df in parts]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query("j15_rating_rules", "SELECT s_suppkey, CASE WHEN s_name LIKE '%7' THEN 'D' WHEN s_acctbal > 6000 THEN 'A' WHEN s_acctbal > 3000 THEN 'B' ELSE 'C' END AS rating FROM supplier")
def j15(t):
    rating = F.when(F.col("s_name").rlike("7$"), "D").when(F.col("s_acctbal") > 6000, "A").when(F.col("s_acctbal") > 3000, "B").otherwise("C")
    return t.supplier.select("s_suppkey", rating.alias("rating"))


@query("j16_read_marks", "SELECT user_id, event_type, max(ts) AS read_at FROM events GROUP BY 1, 2")
def j16(t):
    return t.events.groupBy("user_id", "event_type").agg(F.max("ts").alias("read_at"))


@query("j17_age_delete", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND event_type <> 'click'")
def j17(t):
    return t.events.filter((F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")) & (F.col("event_type") != "click")).select("event_id")


@query("j20_run_state", "SELECT event_type, max(ts) AS last_at, arg_max(user_id, struct_pack(ts := ts, id := event_id)) AS last_user, max(ts) FILTER (value > 50) AS success_at FROM events GROUP BY 1")
def j20(t):
    return t.events.groupBy("event_type").agg(F.max("ts").alias("last_at"), F.max_by("user_id", F.struct("ts", "event_id")).alias("last_user"), F.max(F.when(F.col("value") > 50, F.col("ts"))).alias("success_at"))


@query("j23_guarded_delete", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders, (SELECT count(*) FROM events WHERE user_id = c_custkey) AS reads, NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AND NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey) AS deleted FROM customer WHERE c_acctbal < 0")
def j23(t):
    return C.guarded_delete(t.customer, "c_custkey", t.customer.filter("c_acctbal < 0"), {"orders": (t.orders, "o_custkey"), "reads": (t.events, "user_id")})


@query("i43_json_lists", "SELECT event_id, CASE WHEN user_id % 3 = 0 THEN [] ELSE [event_type, CAST(user_id AS VARCHAR)] END AS items FROM events")
def i43(t):
    text = F.when(F.col("user_id") % 3 == 0, F.lit("{bad")).otherwise(F.concat(F.lit('[" '), "event_type", F.lit('", "", "'), F.col("user_id").cast("string"), F.lit('"]')))
    parsed = F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
    return t.events.select("event_id", F.filter(F.transform(parsed, lambda x: F.trim(x)), lambda x: x != "").alias("items"))
