"""Graph, coupling and numeric queries over the star-schema portfolio, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom.operators import coupling, graph
from strataloom.sources import star
from strataloom.storage import settle

S, D = SparkSession, DataFrame
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = f"with recursive {star.SQL}, {sql}" if sql.lstrip().startswith("x_") else f"with recursive {star.SQL} {sql}"
        return f

    return add


@query("a1_adjacency", "select src, dst, w from calls")
def a1(s: S, d: str) -> D:
    nxt = F.lead("program").over(Window.partitionBy("job").orderBy("step"))
    raw = star.steps(s, d).select(F.col("program").alias("src"), nxt.alias("dst")).where("dst is not null and src <> dst")
    return graph.adjacency(raw.withColumn("w", F.lit(1.0)))


SYM = "x_both as (select src, dst, w from calls union all select dst, src, w from calls), x_sym as (select src, dst, sum(w) / 2 w from x_both group by 1, 2), x_deg as (select id, coalesce(sum(w), 0.0)::double degree from programs left join x_sym on src = id group by 1)"


@query("a2_symmetric", f"{SYM} select src, dst, w from x_sym")
def a2(s: S, d: str) -> D:
    return graph.symmetric(star.calls(s, d))


@query("a3_isolated", "select id from programs where id not in (select id from called)")
def a3(s: S, d: str) -> D:
    return graph.isolated(star.calls(s, d), star.programs(s, d))


@query("a3_degrees", f"{SYM} select id, round(degree, 6) degree from x_deg")
def a3b(s: S, d: str) -> D:
    return graph.degrees(star.calls(s, d), star.programs(s, d)).select("id", F.round("degree", 6).alias("degree"))


@query("a4_graph_stats", f"{SYM}, x_n as (select count(*) n, count(*) filter (degree = 0) isolated, min(degree) mi, avg(degree) av, max(degree) ma from x_deg), x_e as (select count(*) e from calls) select n nodes, e edges, isolated, round(e / (n * (n - 1)), 9) density, mi min_degree, round(av, 6) avg_degree, ma max_degree from x_n, x_e")
def a4(s: S, d: str) -> D:
    return graph.stats(star.calls(s, d), star.programs(s, d)).withColumns({"density": F.round("density", 9), "avg_degree": F.round("avg_degree", 6)})


@query("a6_call_metrics", "x_r as (select case when dst % 5 = 0 then 'DYNAMIC_UNRESOLVED' when dst % 7 = 0 then 'UNRESOLVED_EXTERNAL' else 'RESOLVED' end status from calls) select count(*) total, count(*) filter (status = 'RESOLVED') resolved, count(*) filter (status = 'UNRESOLVED_EXTERNAL') unresolved, count(*) filter (status = 'DYNAMIC_UNRESOLVED') dynamic, case when count(*) > 0 then round(count(*) filter (status = 'RESOLVED') / count(*), 4) else 1.0 end ratio from x_r")
def a6(s: S, d: str) -> D:
    status = F.when(F.col("dst") % 5 == 0, "DYNAMIC_UNRESOLVED").when(F.col("dst") % 7 == 0, "UNRESOLVED_EXTERNAL").otherwise("RESOLVED")
    return coupling.call_metrics(star.calls(s, d).select(status.alias("status")))


@query("a7_shared_datasets", "select resource, count(distinct program) n_programs, array_to_string(list_sort(list(distinct program::varchar)), ',') programs from accesses where kind = 'dataset' group by 1 having count(distinct program) >= 2")
def a7(s: S, d: str) -> D:
    return coupling.shared_resources(star.accesses(s, d).where("kind = 'dataset'"))


PAIRS = """x_one as (select distinct program, resource, kind from accesses),
x_res as (select a.program a, b.program b, count(*) filter (a.kind = 'table') tables, count(*) filter (a.kind = 'dataset') datasets, count(*) filter (a.kind = 'job') jobs
  from x_one a join x_one b on a.resource = b.resource and a.kind = b.kind and a.program < b.program group by 1, 2),
x_call as (select least(src, dst) a, greatest(src, dst) b, count(*) calls from calls group by 1, 2),
x_pair as (select a, b, coalesce(tables, 0) tables, coalesce(datasets, 0) datasets, coalesce(jobs, 0) jobs, coalesce(calls, 0) calls from x_res full join x_call using (a, b))"""


@query("a8_coupling", f"{PAIRS} select a, b, tables, datasets, calls, 2 * tables + datasets + calls score from x_pair where 2 * tables + datasets + calls > 0")
def a8(s: S, d: str) -> D:
    return coupling.coupling(star.uses(s, d), star.calls(s, d))


FRICTION = f"{PAIRS}, x_f as (select *, 3.0::double * tables + 2 * datasets + 3.5::double * jobs + 2 * calls score, tables >= 2 or (tables >= 1 and jobs >= 1) barrier from x_pair)"


@query("a9_friction", f"{FRICTION} select a, b, tables, datasets, jobs, calls, score, barrier, case when barrier then 'CRITICAL' when score >= 6 then 'HIGH' when score >= 3 then 'MEDIUM' else 'LOW' end level from x_f where score > 0")
def a9(s: S, d: str) -> D:
    return coupling.friction(star.uses(s, d), star.calls(s, d))


def _edges(s: S, d: str) -> D:
    return star.calls(s, d)


CLOSURE = "x_reach as (select id seed, id from called union select seed, dst from x_reach join calls on src = id), x_hop as (select id seed, id, 0 hop from called union select seed, dst, hop + 1 from x_hop join calls on src = id where hop < 40), x_min as (select seed, id, min(hop) hop from x_hop group by 1, 2)"


@query("a17_separability", f"{PAIRS.replace('x_pair as', 'x_pairs as')}, x_b as (select a id, count(*) filter (tables >= 2 or (tables >= 1 and jobs >= 1)) n, count(*) total from x_pairs group by 1), x_i as (select id, greatest(10.0, round(greatest(0.0, 100 * (1 - n / total)) - least(50.0, 10.0 * n), 1))::double index from x_b) select id, index, case when index >= 80 then 'LOW' when index >= 60 then 'MEDIUM' when index >= 40 then 'HIGH' else 'CRITICAL' end grade from x_i")
def a17(s: S, d: str) -> D:
    sums = coupling.pair_sums(star.uses(s, d), star.calls(s, d))
    per = sums.where("after > 0").select("id", F.col("barred_after").alias("n"), F.col("after").alias("total"))
    return per.select("id", coupling.separability(F.col("n") / F.col("total"), F.col("n")).alias("index")).withColumn("grade", coupling.risk_grade(F.col("index")))


@query("a18_waves", f"{CLOSURE}, {PAIRS}, x_bar as (select a id from x_pair where tables >= 2 or (tables >= 1 and jobs >= 1) union select b from x_pair where tables >= 2 or (tables >= 1 and jobs >= 1)), x_blast as (select seed id, count(*) - 1 blast from x_min group by 1), x_w as (select id, id in (select id from x_bar) barrier, coalesce(blast, 0) blast from programs left join x_blast using (id)) select id, barrier, blast, case when not barrier and blast <= 1 then 1 when barrier or blast >= 5 then 3 else 2 end wave from x_w")
def a18(s: S, d: str) -> D:
    e = settle(_edges(s, d))
    bars = coupling.barred(star.uses(s, d)).withColumn("barrier", F.lit(True))
    blast = graph.reach_counts(graph.reverse(e), star.ends(e)).withColumnRenamed("n", "blast")
    rows = star.programs(s, d).join(bars, "id", "left").join(blast, "id", "left").select("id", F.coalesce("barrier", F.lit(False)).alias("barrier"), F.coalesce("blast", F.lit(0)).alias("blast"))
    return rows.withColumn("wave", coupling.migration_wave(F.col("barrier"), F.col("blast")))


@query("j1_def_use", "select distinct w.program src, r.program dst, w.resource var from accesses w join accesses r on w.resource = r.resource and w.program <> r.program where w.kind = 'dataset' and r.kind = 'dataset' and w.mode = 'WRITE' and r.mode = 'READ'")
def j1(s: S, d: str) -> D:
    a = star.accesses(s, d).where("kind = 'dataset'").select(F.lit("P").alias("program"), F.col("program").alias("id"), F.col("resource").alias("var"), "mode")
    return graph.def_use(a.where("mode = 'WRITE'"), a.where("mode = 'READ'")).select("src", "dst", "var")


@query("j6_dangling_edges", "x_solvent as (select s_suppkey id from supplier where s_acctbal > 0) select src, dst, w from calls where src in (select id from x_solvent) and dst in (select id from x_solvent)")
def j6(s: S, d: str) -> D:
    return graph.existing(_edges(s, d), star.table(s, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("id"))).select("src", "dst", "w")


@query("j7_prefix_resolution", "x_n as (select split_part(p_name, ' ', 1) target, p_partkey caller from part), x_p as (select upper(left(p_type, 3)) name, min(p_partkey) ord from part group by 1 union select p_brand, min(p_partkey) from part group by 1), x_t as (select distinct upper(target) target from x_n), x_m as (select target, name, case when target = name then -1 else ord end o from x_t join x_p on starts_with(target, name) or starts_with(name, target) where target <> ''), x_b as (select target, arg_min(name, (o, name)) resolved from x_m group by 1) select caller, upper(x_n.target) target, resolved from x_n left join x_b on x_b.target = upper(x_n.target)")
def j7(s: S, d: str) -> D:
    part = star.table(s, d, "part")
    calls = part.select(F.col("p_partkey").alias("caller"), F.upper(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("target"))
    names = part.groupBy(F.upper(F.substring("p_type", 1, 3)).alias("name")).agg(F.min("p_partkey").alias("ord")).union(part.groupBy("p_brand").agg(F.min("p_partkey")))
    return coupling.resolve_by_prefix(calls, names).select("caller", "target", "resolved")


@query("j11_crossing_edges", "select src, dst, w, src % 2 part_src, dst % 2 part_dst from calls where src % 2 <> dst % 2")
def j11(s: S, d: str) -> D:
    return graph.crossing(_edges(s, d), star.called(s, d).withColumn("part", F.col("id") % 2)).select("src", "dst", "w", "part_src", "part_dst")


@query("g1_forward_slice", f"{CLOSURE} select seed, id from x_reach")
def g1(s: S, d: str) -> D:
    e = settle(_edges(s, d))
    return graph.reach(e, star.ends(e), hops=False)


@query("g2_bfs_hops", f"{CLOSURE} select seed, id, hop from x_min")
def g2(s: S, d: str) -> D:
    e = settle(_edges(s, d))
    return graph.reach(e, star.ends(e))


@query("g4_blast_radius", f"{CLOSURE}, x_d as (select seed id, count(*) - 1 down from x_min group by 1), x_u as (select id, count(*) - 1 up from x_min group by 1), x_do as (select src id, count(distinct dst) direct_down from calls group by 1), x_di as (select dst id, count(distinct src) direct_up from calls group by 1) select id, coalesce(direct_up, 0) direct_up, coalesce(direct_down, 0) direct_down, coalesce(down, 0) down, coalesce(up, 0) up, round(coalesce(down, 0) / greatest(1, (select count(*) from called) - 1), 4) impact from called left join x_d using (id) left join x_u using (id) left join x_do using (id) left join x_di using (id)")
def g4(s: S, d: str) -> D:
    e = settle(_edges(s, d))
    return graph.blast_radius(e, star.ends(e))


@query("g5_scc", f"{CLOSURE}, x_m as (select a.seed id, a.id other from x_reach a join x_reach b on a.seed = b.id and a.id = b.seed) select id, min(other) scc, count(*) > 1 cyclic from x_m group by 1")
def g5(s: S, d: str) -> D:
    return graph.strong_components(_edges(s, d), star.called(s, d))


@query("g6_reverse_reach", f"{CLOSURE} select distinct id terminal, seed id from x_min where id in (select s_suppkey from supplier where s_acctbal < 0)")
def g6(s: S, d: str) -> D:
    """What reaches the programs of suppliers in debt."""
    e = _edges(s, d)
    ends = star.called(s, d).join(star.table(s, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("id")), "id", "left_semi")
    return graph.reach(graph.reverse(e), ends).select(F.col("seed").alias("terminal"), "id")


@query("g10_components", "x_both as (select src, dst from calls union select dst, src from calls), x_r as (select id seed, id from called union select seed, dst from x_r join x_both on src = id), x_c as (select seed id, min(id) component from x_r group by 1) select id, coalesce(component, id) component from programs left join x_c using (id)")
def g10(s: S, d: str) -> D:
    return graph.components(_edges(s, d), star.programs(s, d))


@query("n1_laplacian", f"{SYM} select src i, dst j, -w v from x_sym union all select id, id, degree from x_deg where degree > 0")
def n1(s: S, d: str) -> D:
    return graph.laplacian(_edges(s, d), star.programs(s, d))


@query("n1_laplacian_normalised", f"{SYM} select src i, dst j, round(-w / sqrt(a.degree * b.degree), 6) v from x_sym join x_deg a on a.id = src join x_deg b on b.id = dst union all select id, id, 1.0 from x_deg where degree > 0")
def n1b(s: S, d: str) -> D:
    return graph.laplacian(_edges(s, d), star.programs(s, d), normalised=True).withColumn("v", F.round("v", 6))


P = "x_out as (select src, sum(w) total from calls group by 1), x_p as (select calls.src, dst, w / total p from calls join x_out using (src) union all select id, id, 1.0 from called where id not in (select src from calls))"


@query("n12_transition", f"{P} select src, dst, round(p, 9) p from x_p")
def n12(s: S, d: str) -> D:
    return graph.transition(_edges(s, d), star.called(s, d)).withColumn("p", F.round("p", 9))


def _diffused(factor: str, steps: int) -> str:
    """SQL: the sum of factor(k) times the k-th product, k up to ``steps``."""
    return f"{P}, x_u as (select 0 k, min(src) id, 1.0::double u from calls union all select k + 1, dst, sum(u * p) from x_u join x_p on src = id where k < {steps} group by 1, 2) select id, round(sum(u * {factor}), 8) u from x_u group by 1"


def _first(s: S, d: str) -> D:
    return star.called(s, d).agg(F.min("id").alias("id")).where("id is not null")


def _source(s: S, d: str) -> D:
    return _edges(s, d).agg(F.min("src").alias("id")).where("id is not null")


@query("n10_impact", _diffused("exp(-1.5) * 1.5 ** k / factorial(k::integer)", 24))
def n10(s: S, d: str) -> D:
    return graph.impact(_edges(s, d), star.called(s, d), _source(s, d)).withColumn("u", F.round("u", 8))


@query("n14_personalised_rank", _diffused("0.15 * 0.85 ** k", 200))
def n14(s: S, d: str) -> D:
    return graph.personalised_rank(_edges(s, d), star.called(s, d), _source(s, d)).withColumn("u", F.round("u", 8))


@query("w1_bfs_ranking", f"{CLOSURE}, x_s as (select min(id) seed from called), x_h as (select c.id, coalesce(m.hop, 999999) hop from called c left join x_min m on m.id = c.id and m.seed = (select seed from x_s) where c.id <> (select seed from x_s)) select id, hop, row_number() over (order by hop, id) rank from x_h")
def w1(s: S, d: str) -> D:
    first = _first(s, d)
    hops = graph.reach(_edges(s, d), first).select("id", "hop")
    rows = star.called(s, d).join(first, "id", "left_anti").join(hops, "id", "left").select("id", F.coalesce("hop", F.lit(999999)).alias("hop"))
    return graph.ranking(rows, "hop", ascending=True)


@query("w6_sweep_conductance", "x_a as (select src, dst, w from calls union all select dst, src, w from calls), x_d as (select src id, sum(w) degree from x_a group by 1), x_o as (select id, degree, row_number() over (order by degree, id) rank from x_d), x_c as (select o.rank, o.id, sum(case when a.rank <= o.rank and b.rank > o.rank then w else 0 end) cut, sum(case when a.rank <= o.rank then w else 0 end) volume, sum(w) total from x_o o, x_a join x_o a on a.id = src join x_o b on b.id = dst group by 1, 2) select rank, id, cut, volume, round(cut / least(volume, total - volume), 6) conductance from x_c where least(volume, total - volume) > 1e-9")
def w6(s: S, d: str) -> D:
    e = _edges(s, d)
    both = e.union(e.select("dst", "src", "w"))
    scores = both.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("score"))
    return graph.sweep(e, scores).withColumn("conductance", F.round("conductance", 6))


@query("w10_top_partners", "x_a as (select src, dst, w from calls union all select dst, src, w from calls), x_s as (select src, dst, sum(w) w from x_a group by 1, 2), x_r as (select *, row_number() over (partition by src order by w desc, dst) rank from x_s) select src, dst, w, rank from x_r where rank <= 3")
def w10(s: S, d: str) -> D:
    return graph.top_partners(_edges(s, d), 3)


@query("u1_union_slice", f"{CLOSURE}, x_s as (select min(id) seed from called) select id from x_min where seed = (select seed from x_s) union select seed from x_min where id = (select seed from x_s)")
def u1(s: S, d: str) -> D:
    e, first = _edges(s, d), _first(s, d)
    return graph.reach(e, first).select("id").union(graph.reach(graph.reverse(e), first).select("id")).distinct()


@query("u4_mirrored_pairs", "select least(src, dst) a, greatest(src, dst) b, sum(w) w from calls group by 1, 2")
def u4(s: S, d: str) -> D:
    return graph.mirrored(_edges(s, d))
