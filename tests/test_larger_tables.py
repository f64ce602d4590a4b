"""Queries on tables like the larger ones: repeated rows, shifted keys, names that several rows share."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom import storage
from strataloom.operators import coupling, graph, portfolio, spectral
from strataloom.plans import catalog, source_queries
from strataloom.sources import jcl
from tests.conftest import SMALL

KEYS = {"supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey"]}


def repeated(folder, copies: int, shift: int) -> str:
    """The smallest tables repeated, keys shifted by a multiple of ``shift`` in each copy."""
    c = duckdb.connect()
    for table, keys in KEYS.items():
        moved = ", ".join(f"({k} + i * {shift})::bigint as {k}" for k in keys)
        c.sql(f"copy (select t.* replace ({moved}) from range({copies}) r(i), (select * from '{SMALL}/{table}.parquet') t) to '{folder}/{table}.parquet' (format parquet)")
    return str(folder)


def wanted(sf: str, name: str, columns: list[str]) -> list[tuple]:
    c = duckdb.connect()
    for table in KEYS:
        c.sql(f"create view {table} as select * from '{sf}/{table}.parquet'")
    got = c.sql(catalog.ORACLES[name])
    at = [got.columns.index(x) for x in columns]
    return sorted((tuple(r[i] for i in at) for r in got.fetchall()), key=str)


def same(spark, sf: str, name: str) -> None:
    df = catalog.QUERIES[name](spark, sf)
    assert sorted((tuple(r) for r in df.collect()), key=str) == wanted(sf, name, df.columns)


@pytest.fixture(scope="module")
def shared_names(tmp_path_factory):
    """Keys of seven signs, of which a program's name holds six."""
    return repeated(tmp_path_factory.mktemp("names"), 2, 1_000_000)


def test_programs_of_one_name_are_compared_each_with_its_own_candidate(spark, shared_names):
    same(spark, shared_names, "x5_equivalence")


def test_a_balance_that_only_the_candidate_lifts_over_its_limit_is_judged_by_its_original(spark, tmp_path):
    """With 10 more the balance equals the limit, with 11 it is above: posted by the candidate alone, which then may run for ever."""
    sf = repeated(tmp_path, 3, 1_000)
    duckdb.sql(f"copy (select * replace (s_suppkey % 25 as s_nationkey, (s_suppkey % 25) * 100.0 - 10 as s_acctbal) from '{SMALL}/supplier.parquet') to '{tmp_path}/supplier.parquet' (format parquet)")
    same(spark, sf, "x5_equivalence")


def test_a_search_keeps_a_word_per_node_where_neighbours_reach_the_same(spark):
    """128 stars of 64 nodes: every node is reached by the 64 seeds of its own star, which share one word."""
    e = spark.range(8_192).selectExpr("id div 64 * 64 as src", "id as dst").where("src <> dst")
    both = e.union(e.selectExpr("dst", "src"))
    search = graph._Search(both, spark.range(8_192))
    assert search.seen.count() == 8_192
    search.clear_all()
    got = graph.reach_both(both.where("src < 128 and dst < 128"), spark.range(130)).collect()
    assert len(got) == 130 and all((r.down, r.up) == ((63, 63) if r.id < 128 else (0, 0)) for r in got)


@pytest.mark.parametrize("whole", [True, False])
def test_searches_of_strips_and_of_blocks_find_the_same(spark, monkeypatch, whole):
    """A dense part, a chain and single nodes, against a plain search; strips of one word, and words handed on a few at a time."""
    monkeypatch.setattr(graph, "WHOLE_EDGES", 40_000_000 if whole else 0, raising=False)
    monkeypatch.setattr(graph, "STRIP_BYTES", 1, raising=False)
    monkeypatch.setattr(graph, "EMITTED", 100, raising=False)
    r = np.random.default_rng(5)
    near = {(int(a), int(b)) for a, b in r.integers(0, 150, (4_000, 2))} | {(k, k + 1) for k in range(147, 152)} | {(300, 301), (302, 302)}
    onward: dict = {}
    for a, b in near:
        onward.setdefault(a, set()).add(b)
    seeds = [*range(0, 160, 2), 300, 302, 400]
    want = {}
    for seed in seeds:
        hop, front = 0, {seed}
        while front:
            want |= {(seed, x): hop for x in front}
            hop, front = hop + 1, {y for x in front for y in onward.get(x, ()) if (seed, y) not in want}
    e = spark.createDataFrame([(a * 7, b * 7) for a, b in near], "src long, dst long")
    s = spark.createDataFrame([(x * 7,) for x in seeds], "id long")
    assert {(x.seed // 7, x.id // 7): x.hop for x in graph.reach(e, s).collect()} == want
    assert {(x.seed // 7, x.id // 7): x.hop for x in graph.reach(e, s, max_hops=2).collect()} == {k: h for k, h in want.items() if h <= 2}
    pairs = [tuple(x) for x in graph.reach(e, s, hops=False).collect()]
    assert len(pairs) == len(want) and {(a // 7, b // 7) for a, b in pairs} == set(want)
    up, down = ({x: sum(k[end] == x and k[0] != k[1] for k in want) for x in {k[end] for k in want}} for end in (1, 0))
    assert {x.id // 7: x.n for x in graph.reach_counts(e, s).collect()} == up
    assert {x.id // 7: (x.down, x.up) for x in graph.reach_both(e, s).collect()} == {x: (down.get(x), n) for x, n in up.items()}


def test_words_of_a_dense_search_do_not_leave_blocks(spark, monkeypatch):
    """Where all reach all, blocks handed on each target's words once per block."""
    monkeypatch.setattr(graph, "_followed", None)
    e = spark.range(200).join(spark.range(200).withColumnRenamed("id", "to")).selectExpr("id as src", "to as dst").where("src <> dst")
    assert {(x.down, x.up) for x in graph.reach_both(e, spark.range(200)).collect()} == {(199, 199)}


def test_pairs_of_a_search_are_made_when_they_are_read(spark, monkeypatch):
    written = []
    monkeypatch.setattr(storage.Scratch, "settle", lambda self, df, rows=None, real=storage.Scratch.settle: written.append(tuple(df.columns)) or real(self, df, rows))
    pairs = graph.reach(spark.range(100).selectExpr("id as src", "(id + 1) % 100 as dst"), spark.range(3), max_hops=2)
    assert ("seed", "id", "hop") not in written
    assert sorted(map(tuple, pairs.collect())) == sorted((s, s + h, h) for s in range(3) for h in range(3))


def test_call_circles_parse_no_jobs(spark, monkeypatch):
    def parsed(jobs):
        bad = jobs.withColumn("text", F.raise_error(F.concat(F.lit("a job was parsed: "), "job_file")).cast("string"))
        return real(bad)

    real = jcl.parsed
    monkeypatch.setattr(jcl, "parsed", parsed)
    assert sorted(map(tuple, catalog.QUERIES["g11_call_cycles"](spark, SMALL).collect())) == wanted(SMALL, "g11_call_cycles", ["id", "scc", "size"])


def test_coupling_counts_pairs_where_their_blocks_are(spark):
    """Against a plain loop, over several blocks, with resources of few and of many programs."""
    from itertools import combinations

    uses = [(p, f"R{r}", k) for p in range(150) for r, k, of in ((p % 9, "dataset", 1), (0, "table", 1), (p % 2 + 1, "table", 3), (p // 3, "job", 1)) if p % of == 0]
    called = [(1, 149), (149, 1), (7, 8), (5, 5)]
    want: dict = {}
    for (p, r, k), (q, t, m) in combinations(sorted(set(uses)), 2):
        if p < q and (r, k) == (t, m):
            want.setdefault((p, q), [0, 0, 0, 0])[("table", "dataset", "job").index(k)] += 1
    for p, q in called[:3]:
        want.setdefault((min(p, q), max(p, q)), [0, 0, 0, 0])[3] += 1
    a = spark.createDataFrame(uses + uses[:40], "program long, resource string, kind string")
    c = spark.createDataFrame(called, "src long, dst long")
    pairs = {(r.a, r.b): [r.tables, r.datasets, r.jobs, r.calls] for r in coupling.pair_counts(a, c).collect()}
    assert pairs == want
    sums = {r.id: r for r in coupling.pair_sums(a, c).collect()}
    for p in range(150):
        mine = [v for (x, _), v in want.items() if x == p]
        assert (sums[p].after, sums[p].barred_after) == (len(mine), sum(t >= 2 or (t >= 1 and j >= 1) for t, _, j, _ in mine))
    far = a.selectExpr("program * 31 as program", "resource", "kind")  # 150 programs among 4650 numbers
    more = far.union(spark.range(4_650).selectExpr("id", "concat('own', id)", "'job'"))
    assert {(r.a, r.b): r.datasets for r in coupling.pair_counts(more).where("datasets > 0").collect()} == {(x * 31, y * 31): v[1] for (x, y), v in want.items() if v[1]}


def test_barriers_are_found_without_pairs_of_programs(spark, monkeypatch):
    """Against the sums of pairs: two tables, a table and a job, one of them alone, and equal sets of tables."""
    r = np.random.default_rng(3)
    uses = [(int(p), f"{k}{x}", k) for k, n, of in (("table", 60, 40), ("job", 120, 50), ("dataset", 50, 9)) for p, x in zip(r.integers(0, 80, n), r.integers(0, of, n), strict=True)]
    uses += [(p, x, "table") for p in (90, 91) for x in ("A", "B")] + [(92, "C", "table"), (93, "C", "table"), (93, "J", "job"), (92, "J", "job"), (94, "C", "table"), (94, None, "job"), (95, "J", "job")]
    a = spark.createDataFrame(uses + uses[:30], "program long, resource string, kind string")
    want = {x.id for x in coupling.pair_sums(a).where("barred_after + barred_before > 0").collect()}
    got = [x.id for x in coupling.barred(a).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {90, 91, 92, 93} <= want and 94 not in want and len(want) > 8
    monkeypatch.setattr(coupling, "_by_block_pairs", None)
    assert sorted(map(tuple, catalog.QUERIES["a18_waves"](spark, SMALL).collect())) == wanted(SMALL, "a18_waves", ["id", "barrier", "blast", "wave"])


def test_anchors_of_few_words_and_repeated_rows_are_found_as_by_sql(spark, tmp_path):
    c = duckdb.connect()
    c.sql("create table documents as select * from (values (1, 'one two three four five six seven eight nine ten'), (1, 'nine  ten'), (2, 'xone two'), (3, ''), (4, null), (5, 'ten')) t(doc_id, text)")
    c.sql("create table benchmark as select * from (values (1, 'two three'), (2, 'ten'), (3, 'two three four five six seven eight nine never'), (4, ''), (5, null), (6, 'one two'), (7, 'two three')) t(item_id, text)")
    for t in ("documents", "benchmark"):
        c.sql(f"copy {t} to '{tmp_path}/{t}.parquet' (format parquet)")
    got = sorted(map(tuple, catalog.QUERIES["j12_anchor_remap"](spark, str(tmp_path)).collect()))
    assert got == sorted(c.sql(catalog.ORACLES["j12_anchor_remap"]).fetchall()) and len(got) > 6


ODD_JOBS = {
    "a.jcl": "//A JOB 1\n//S1 EXEC PGM=P1\n//D1 DD DSN=X,DISP=SHR\n//S1 EXEC PGM=P2\n//D2 DD DSN=Y,DISP=OLD\n//NONE EXEC PROCX\n//D3 DD DSN=Z,DISP=(NEW,\n// CATLG)",
    "b.jcl": "//D0 DD DSN=LOST\n//S9 EXEC PGM=P2\n//B JOB 1\n//A JOB 1\n//S1 EXEC PGM=P1X\n//D DD SYSOUT=*\n//D DD DSN=W",
    "c.jcl": "//C.D JOB 1\n//S EXEC PGM=P1\n//X DD DSN='Q',DISP=SHR\n//C JOB 1\n//D.S EXEC PGM=P3\n//T EXEC PGM=P1X\n//U EXEC PGM=P1",
    "e.jcl": "//E JOB 1\n//S1 EXEC PGM=P1\n//D DD DSN=X,DISP=SHR\n//S2 EXEC PGM=P1X\n//* remark\n//D DD DSN=X,DISP=MOD",
    "f.jcl": "",
}


@pytest.fixture(scope="module")
def odd_portfolio(spark):
    """Jobs whose steps share ids with other steps, and one whose steps don't; P1X resolves to P1."""
    sources = spark.createDataFrame([("P1", "EXEC SQL UPDATE T1 SET A = 1 END-EXEC.\nCALL 'P3'."), ("P2", "CALL 'P1'."), ("P4", "CALL 'NOWHERE'.")], "program string, source string")
    jobs = spark.createDataFrame([*ODD_JOBS.items(), ("g.jcl", None), ("a.jcl", ODD_JOBS["a.jcl"])], "job_file string, text string")
    return portfolio.Parsed(sources, jobs)


def test_each_job_is_parsed_once(spark, monkeypatch):
    read = []
    monkeypatch.setattr(storage.Scratch, "settle", lambda self, df, rows=None, real=storage.Scratch.settle: read.append(df.columns) or real(self, df, rows))
    for name in ("a5_type_counts", "g14_portfolio_metrics", "j9_resource_map", "g12_portfolio"):
        read.clear()
        plan = catalog.QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert read.count(["job_file", "job", "steps"]) == 1 and "job_file#" not in "".join(x for x in plan.splitlines() if "MapInArrow" in x)


def test_steps_that_share_their_ids_count_as_by_joins_of_edges(spark, odd_portfolio):
    p = odd_portfolio
    nodes, edges = portfolio.graph_of(p)
    assert {r.job for r in p.alone.collect()} == {"E", "ANONJOB", "B"} and {r.job for r in p.shared.collect()} == {"A", "C", "C.D"}
    assert sorted(map(tuple, portfolio.uses(p).collect())) == sorted(map(tuple, portfolio.accesses(edges).collect()))
    assert sorted(map(tuple, portfolio.uses(p, jobs=False).collect())) == sorted(map(tuple, portfolio.accesses(edges).where("kind <> 'job'").collect()))
    ids = [r.id for r in nodes.collect()]
    assert len(ids) == len(set(ids)) and set(ids) >= {x for r in edges.collect() for x in (r.src, r.dst)}
    counts = {(r.what, r.type): r.n for r in portfolio.type_counts(nodes, edges).collect()}
    assert counts["node", "job"] == 6 and counts["node", "step"] == 8 and counts["edge", "JOB_STEP"] == 14


def test_grouped_jobs_hold_what_their_cards_say(spark, odd_portfolio):
    rows = jcl.parsed(spark.createDataFrame([*ODD_JOBS.items(), ("a.jcl", ODD_JOBS["a.jcl"])], "job_file string, text string")).where("step is not null")
    p = odd_portfolio
    steps = sorted((r.job_file, r.job, r.step_seq + 1, r.step, r.program or "") for r in p.all_steps().collect())
    assert steps == sorted((r.job_file, r.job, r.step_seq, r.step, r.program or "") for r in rows.where("dd is null").collect())
    uses = sorted((r.job, r.step, *r.u) for r in p.all_steps().select("job", "step", F.explode("uses").alias("u")).collect())
    assert uses == sorted((r.job, r.step, r.dd, r.dsn, r.intent) for r in rows.where("dsn is not null").collect())


def test_portfolio_queries_equal_sql_where_job_names_are_shared(spark, tmp_path):
    """Keys of eight signs, of which a job's name holds seven."""
    sf = repeated(tmp_path, 2, 10_000_000)
    for name in ("a5_type_counts", "j9_resource_map", "g14_portfolio_metrics"):
        same(spark, sf, name)


def test_a_dossier_makes_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(coupling, "pair_counts", None)
    assert catalog.QUERIES["x16_dossier"](spark, SMALL).count()


def test_pairs_of_programs_that_use_the_same_are_counted_by_class(spark, monkeypatch):
    """Six classes of programs, dealt over lists of seven; calls inside a list, across lists and classes, both ways, and without resources."""
    uses = [(f"PGM:P{p:02}", r, r.split(":")[0]) for p in range(90) for r in (f"dataset:{p % 3}", f"table:{p % 2}") if p % 3 or p % 2]
    uses += [(p, f"job:{p}", "job") for p, _, _ in uses]
    calls = [(f"PGM:P{a:02}", f"PGM:P{b:02}") for a, b in ((1, 7), (7, 1), (1, 8), (88, 4), (0, 6), (5, 0), (3, 3), (89, 83), (2, 1), (4, 3), (10, 70))]
    access = spark.createDataFrame(uses + uses[:50], "program string, resource string, kind string")
    edges = spark.createDataFrame([(a, b, "CALL_RESOLVED", "OBSERVED") for a, b in calls], "src string, dst string, edge_type string, status string")
    known = sorted((r.a, r.b, float(r.score)) for r in coupling.coupling(access, edges.select("src", "dst")).collect())
    counted = []
    monkeypatch.setattr(coupling, "pair_counts", lambda a, c=None, real=coupling.pair_counts: counted.append(a.select("program").distinct().count()) or real(a, c))
    monkeypatch.setattr(coupling, "CLASS_LIST", 7, raising=False)
    nodes = spark.createDataFrame([(f"PGM:P{p:02}", "program") for p in range(90)], "id string, node_type string")
    got = portfolio.report(nodes, edges, access).where("section = 'coupling'").collect()
    assert sorted((r.subject, r.other, r.value) for r in got) == known
    assert counted == [5]


def test_a_report_reads_no_nodes_of_jobs(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(portfolio, "graph_of", None)
    same(spark, repeated(tmp_path, 3, 1_000), "g14_portfolio_report")


def jobs_of(n_jobs: int, programs: int, most: int = 7):
    """(n, i, j, w, inner) of jobs whose steps follow each other and run programs, which have a dataset each in two ways."""
    r = np.random.default_rng(1)
    m = r.integers(1, most + 1, n_jobs)
    job = np.repeat(np.arange(n_jobs), m)
    outer = programs + 12
    steps = outer + n_jobs + np.arange(len(job))
    k = r.integers(0, programs, len(job))
    follows = np.flatnonzero(job[1:] == job[:-1])
    i = np.concatenate((outer + job, steps[follows], k, programs + k % 7, programs + 7 + k % 5))
    j = np.concatenate((steps, steps[follows + 1], steps, steps, steps))
    n = outer + n_jobs + len(job)
    return n, i, j, np.ones(len(i)), np.arange(n) >= outer


def laplacian(n, i, j, w):
    matrix = np.zeros((n, n))
    np.add.at(matrix, (i, j), -w / 2)
    np.add.at(matrix, (j, i), -w / 2)
    return matrix - np.diag(matrix.sum(axis=1))


@pytest.mark.parametrize("odd", ["plain", "weights", "a long job", "two parts"])
def test_jobs_and_steps_are_solved_for_exactly(odd):
    n, i, j, w, inner = jobs_of(60, 25, 100) if odd == "a long job" else jobs_of(700, 25)
    if odd == "weights":
        w = np.random.default_rng(2).integers(1, 4, len(i)).astype(float)
    if odd == "two parts":  # a program and its job by themselves
        i, j, w, inner, n = np.append(i, n), np.append(j, n + 1), np.append(w, 1.0), np.append(inner, [False, True]), n + 2
    got = spectral.large_fiedler_vector(n, i, j, w, inner)
    here = np.arange(n) < n - 2 if odd == "two parts" else np.ones(n, dtype=bool)
    assert here.sum() > spectral.DENSE and (got[~here] == -2).all()
    matrix = laplacian(n, i, j, w)[np.ix_(here, here)]
    want = np.linalg.eigh(matrix)[1][:, 1]
    assert min(np.abs(got[here] - want).max(), np.abs(got[here] + want).max()) < 1e-6


def test_equal_jobs_of_one_program_have_no_vector_on_outer_nodes():
    """Their second vector lies on the jobs alone; the plain iteration finds it."""
    i, j = np.array([1, 2]), np.array([2, 9])
    i, j = (np.concatenate([np.where(x == 9, 3000 + np.arange(1500) % 9, x + 2 * np.arange(1500) - 1) for x in part]) for part in (i, j))
    i, j = np.append(i, 3000 + np.arange(8)), np.append(j, 3001 + np.arange(8))
    n, w, inner = 3009, np.ones(3008), np.arange(3009) < 3000
    got = spectral.large_fiedler_vector(n, i, j, w, inner)
    matrix = laplacian(n, i, j, w)
    assert abs(got @ matrix @ got / (got @ got) - np.linalg.eigvalsh(matrix)[1]) < 1e-6


def test_a_large_portfolio_is_numbered_and_solved_like_a_small_one(spark):
    parsed = source_queries._portfolio(spark, SMALL)
    nodes, edges = map(storage.settle, portfolio.graph_of(parsed))
    ids = {r.id: r.score for r in portfolio._large_fiedler(nodes, edges).collect()}
    names = sorted(r.id for r in nodes.collect())
    at = {x: k for k, x in enumerate(names)}
    assert set(ids) == set(names) and len(names) > spectral.DENSE
    x = np.array([ids[v] for v in names])
    e = np.array([(at[r.src], at[r.dst]) for r in edges.collect()])
    y = np.zeros(len(names))
    for a, b in (e.T, e.T[::-1]):
        y += np.bincount(a, (x[a] - x[b]) / 2, len(names))
    value = x @ y / (x @ x)
    assert abs(x.sum()) < 1e-5 and abs(x @ x - 1) < 1e-8 and np.linalg.norm(y - value * x) < 1e-5
    plain = {r.id: r.score for r in portfolio.fiedler(nodes, edges).collect()}
    old = np.array([plain[v] for v in names])
    z = np.zeros(len(names))
    for a, b in (e.T, e.T[::-1]):
        z += np.bincount(a, (old[a] - old[b]) / 2, len(names))
    assert value <= old @ z / (old @ old) + 1e-6


def test_cuts_by_number_are_cuts_by_name(spark, monkeypatch):
    """Two groups of jobs that one step joins; the sweep of a large portfolio gets numbers."""
    parts = [(f"STEP:J{g}{k:02}.S1", f"{kind}:{kind}{g}{k % of}") for g in "AB" for k in range(30) for kind, of in (("PGM", 4), ("DSN", 3))]
    parts += [(f"JOB:J{g}{k:02}", f"STEP:J{g}{k:02}.S1") for g in "AB" for k in range(30)] + [("STEP:JA00.S1", "DSN:DSNB1")]
    edges = spark.createDataFrame([(a, b, "STEP_EXEC" if b[:3] == "PGM" else "STEP_READ_DSN" if b[:3] == "DSN" else "JOB_STEP", 1.0) for a, b in parts], "src string, dst string, edge_type string, w double")
    nodes = spark.createDataFrame([(x, "program" if x[:3] == "PGM" else "other") for x in sorted({x for e in parts for x in e})], "id string, node_type string")
    plain = portfolio.partitions(nodes, edges, 1).collect()
    swept = []
    monkeypatch.setattr(portfolio, "LARGE", 0, raising=False)
    monkeypatch.setattr(graph, "sweep", lambda e, s, real=graph.sweep: swept.append(s.schema["id"].dataType.simpleString()) or real(e, s))
    got = portfolio.partitions(nodes, edges, 1).collect()
    assert got == plain and plain[0].crossing == 1 and {plain[0].programs_a, plain[0].programs_b} == {4}
    assert swept == ["bigint"]
