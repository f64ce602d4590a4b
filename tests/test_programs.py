"""Parsing, linking, cycles, execution and spectra on small programs of our own."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataloom.operators import benchmark, control_flow, cycles, idioms, portfolio, runtime, slicing, spectral
from strataloom.sources import calls, cobol, copybooks, jcl
from strataloom.sources.tokens import Phrase, mentions

TILL = """
       IDENTIFICATION DIVISION.
       PROGRAM-ID. TILL.
       DATA DIVISION.
       WORKING-STORAGE SECTION.
       01 WS-CASH   PIC 9(5)V99 VALUE 100.00.
       01 WS-DUE    PIC 9(5)V99 VALUE 30.00.
       01 WS-STATE  PIC X(4)    VALUE "INIT".
       PROCEDURE DIVISION.
       MAIN-LINE.
           PERFORM CHECK-DUE.
           IF WS-STATE = "OKAY"
               PERFORM PAY-OUT
           ELSE
               MOVE "STOP" TO WS-STATE
           END-IF.
           STOP RUN.
       CHECK-DUE.
           IF WS-DUE IS LESS THAN OR EQUAL TO WS-CASH
               MOVE "OKAY" TO WS-STATE
           ELSE
               MOVE "FAIL" TO WS-STATE
           END-IF.
       PAY-OUT.
           SUBTRACT WS-DUE FROM WS-CASH.
"""
LOOP = """
       PROGRAM-ID. SPIN.
       WORKING-STORAGE SECTION.
       01 WS-READY PIC X VALUE "N".
       01 WS-TRIES PIC 9 VALUE 0.
       PROCEDURE DIVISION.
       AGAIN.
           ADD 1 TO WS-TRIES.
           IF WS-READY = "Y"
               STOP RUN
           ELSE
               PERFORM AGAIN
           END-IF.
           STOP RUN.
"""


@pytest.fixture(scope="module")
def programs(spark):
    return control_flow.parsed(spark.createDataFrame([("till", TILL), ("spin", LOOP)], "program string, source string")).cache()


def test_nodes_and_edges(programs):
    nodes = [r.id for r in control_flow.nodes(programs).where("program = 'till'").orderBy("seq").collect()]
    assert nodes == [
        "MAIN-LINE:L11_PERFORM", "MAIN-LINE:L12_IF", "MAIN-LINE:L17_STOP", "MAIN-LINE:L13_PERFORM", "MAIN-LINE:L15_MOVE",
        "CHECK-DUE:L19_IF", "CHECK-DUE:L20_MOVE", "CHECK-DUE:L22_MOVE", "PAY-OUT:L25_SUBTRACT",
    ]
    edges = {(r.src.split(":")[1], r.dst.split(":")[1], r.edge_type) for r in control_flow.edges(programs).where("program = 'till'").collect()}
    assert ("L11_PERFORM", "L19_IF", "cfg_call") in edges and ("L20_MOVE", "L12_IF", "cfg_return") in edges
    assert ("L22_MOVE", "L25_SUBTRACT", "cfg_fallthrough") in edges and ("L20_MOVE", "L12_IF", "dfg_def_use") in edges
    assert ("L12_IF", "L15_MOVE", "cfg_branch_false") in edges
    assert control_flow.coverage(programs).where("program = 'till'").first().ratio == 1.0


def test_cycles(programs):
    r = {x.program: x for x in cycles.analyse(control_flow.nodes(programs), control_flow.edges(programs)).collect()}
    assert (r["till"].verdict, r["till"].n_sccs) == ("DIRECTED_ACYCLIC_FLOW", 0)
    assert (r["spin"].verdict, r["spin"].n_cycles, r["spin"].recursive) == ("CRITICAL_INFINITE_LOOP", 1, True)


def test_simple_cycles_are_complete():
    after = [[1, 2], [0, 2], [0, 1, 2]]
    got, cut = cycles.simple_cycles([0, 1, 2], after, 100)
    assert sorted(map(tuple, got)) == [(0, 1), (0, 1, 2), (0, 2), (0, 2, 1), (1, 2), (2,)] and not cut
    assert cycles.simple_cycles([0, 1, 2], after, 2)[1]


def test_runs_and_mutants(spark, programs):
    v = runtime.Machine(TILL).run()["variables"]
    assert v["WS-CASH"] == 70.0 and v["WS-STATE"] == "OKAY"
    spin = runtime.Machine(LOOP).run(max_steps=30)
    assert spin["timed_out"] and spin["variables"]["WS-TRIES"] > 5
    base = spark.createDataFrame([("till", "a", TILL, "{}"), ("till", "b", TILL, '{"WS-DUE": 500}')], "program string, case_id string, source string, overrides string")
    other = spark.createDataFrame([("till", "a", TILL.replace("SUBTRACT WS-DUE FROM", "ADD WS-DUE TO"), "{}"), ("till", "b", TILL, '{"WS-DUE": 500}')], base.schema)
    got = {r.case_id: (r.status, r.changed, r.diverged_at) for r in runtime.compare_runs(runtime.execute(base), runtime.execute(other)).collect()}
    assert got["a"][:2] == ("DIVERGED", "WS-CASH") and got["b"] == ("PASS", "", None)
    sources = spark.createDataFrame([("till", TILL)], "program string, source string")
    families = {r.family for r in runtime.mutations(control_flow.nodes(programs).where("program = 'till'"), sources).collect()}
    assert families == {"ARITHMETIC", "COMPARISON", "CALL"}


def test_invariants_come_before_differences(spark):
    cases = spark.createDataFrame([("till", c, TILL, o) for c, o in (("a", "{}"), ("b", '{"WS-DUE": 500}'))], "program string, case_id string, source string, overrides string")
    other = cases.withColumn("source", F.replace("source", F.lit("SUBTRACT WS-DUE FROM"), F.lit("ADD WS-DUE TO")))
    now = runtime.execute(other).cache()
    rules = cases.select("program", "case_id", F.lit("small").alias("name"), F.lit("WS-CASH <= 100").alias("expression"))
    broken = runtime.violations(now, rules)
    assert [(r.case_id, r.violated) for r in broken.collect()] == [("a", "small")]
    got = runtime.compare_runs(runtime.execute(cases), now, violated=broken)
    assert {r.case_id: r.status for r in got.collect()} == {"a": "INVARIANT_VIOLATION", "b": "PASS"}
    assert runtime.verified(got).first().asDict() == {"program": "till", "n": 2, "passed": 1, "rate": 0.5, "status": "OBSERVED_DIVERGED"}


def test_mutation_benchmark(spark, programs):
    """Truth and metrics of one mutant against a plain computation."""
    sources = spark.createDataFrame([("till", TILL)], "program string, source string")
    nodes, edges = (f(programs).where("program = 'till'").cache() for f in (control_flow.nodes, control_flow.edges))
    rows = benchmark.experiments(nodes, edges, sources)
    case = "PAY-OUT:L25_SUBTRACT/ARITHMETIC"
    got = {r.method: r.ap for r in rows.where(F.col("case_id") == case).collect()}
    assert got == dict.fromkeys(("bfs", "diffusion", "random"), 0.0)  # only the changed statement itself runs under another name
    case = "CHECK-DUE:L19_IF/COMPARISON"
    base, mutant = (runtime.Machine(x).run(max_steps=100) for x in (TILL, TILL.replace("LESS THAN", "GREATER THAN")))
    assert mutant["trace"] != base["trace"]
    truth = {i for i in {*base["trace"], *mutant["trace"]} if base["trace"].count(i) != mutant["trace"].count(i)}
    diff = {v for v in base["variables"] if base["variables"][v] != mutant["variables"].get(v)}
    truth |= {r.id for r in nodes.collect() if set(r.writes) & diff}
    truth.discard("CHECK-DUE:L19_IF")
    hop, front, after = {}, {"CHECK-DUE:L19_IF"}, {}
    for r in edges.collect():
        after.setdefault(r.src, set()).add(r.dst)
    step = 0
    while front:
        step += 1
        front = {y for x in front for y in after.get(x, ())} - set(hop) - {"CHECK-DUE:L19_IF"}
        hop |= dict.fromkeys(front, step)
    order = sorted(hop, key=lambda i: (hop[i], i))
    hits = [i in truth for i in order]
    want = sum(sum(hits[: k + 1]) / (k + 1) for k, h in enumerate(hits) if h) / len(truth)
    r = rows.where((F.col("case_id") == case) & (F.col("method") == "bfs")).first()
    assert math.isclose(r.ap, want) and math.isclose(r.p3, sum(hits[:3]) / min(3, len(hits))) and math.isclose(r.rr, 1 / (1 + hits.index(True)))
    total = benchmark.summary(rows).collect()
    assert {x.method for x in total} == {"bfs", "diffusion", "random"} and {x.verdict for x in total} == {"INCONCLUSIVE_INSUFFICIENT_SAMPLES"}


@pytest.mark.parametrize(
    ("text", "want"),
    [("A + 2 * B", 8), ("(A + 2) * B", 12), ("A = 2 AND B > 5", False), ("A = 2 OR B > 5", True), ("NOT A = 2", False), ("'x' = 'x'", True), ("1 / 0", 0), ("UNKNOWN", 0), ("-A + B", 1)],
)
def test_expressions(text, want):
    assert runtime.evaluate(text, {"A": 2, "B": 3}) == want


def test_conditions():
    assert cobol.condition("A IS NOT EQUAL TO 'x = y' OR B GREATER THAN 3 AND C") == "(A != 'x = y' OR (B > 3 AND C = TRUE))"
    assert cobol.condition("A = 1 OR B = 2 AND C = 3", legacy=True) == "((A = 1 OR B = 2) AND C = 3)"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("A NOT GREATER THAN B", "A <= B"), ("A IS GREATER OR EQUAL TO 5", "A >= 5"), ("A EQUALS 'EQUAL TO'", "A = 'EQUAL TO'"), ("READY", "READY = TRUE"), ("A <> B", "A != B"),
        ("(A = 1 OR B = 2) AND C = 3", "((A = 1 OR B = 2) AND C = 3)"), ("A = 'X OR Y'", "A = 'X OR Y'"), ("WS-EQUAL-TO = 1", "WS-EQUAL-TO = 1"), ("A = 1 AND B = 2 AND C", "(A = 1 AND (B = 2 AND C = TRUE))"),
    ],
)
def test_condition_forms(text, want):
    assert cobol.condition(text) == want


def test_tokens():
    p = Phrase("CALL 'A-B' USING X.Y, (Z)")
    assert p.tokens == ["CALL", "'A-B'", "USING", "X", ".", "Y", ",", "(", "Z", ")"] and p.literal(1) == "A-B" and p.word(1) == "" and p.word(99) == p.mark(99) == ""
    assert p.name(3, dots=1) == "X.Y" and p.name(3) == "X" and p.part(2, 4) == "USING X" and p.part(5, 5) == "" and p.find("Z") == 8 and p.find("Q") == -1
    assert Phrase("LINK PROGRAM ('P1') COMMAREA( W-A )").option("COMMAREA") == "W-A" and Phrase("MAP X").option("MAP") == ""
    assert mentions("A-B + WS", "A") and not mentions("AB + A_B", "A") and mentions("xA A", "A")


def test_statements():
    def got(text):
        s = cobol.statement(7, text)
        return s.kind, s.code, s.targets, s.sources, s.operands, s.in_place

    assert got("MOVE 'A TO B' TO X, Y Z.") == ("MOVE", "MOVE 'A TO B' TO X, Y, Z", ["X", "Y", "Z"], ["'A TO B'"], [], False)
    assert got("SUBTRACT A FROM B GIVING C.") == ("SUBTRACT", "SUBTRACT A FROM B GIVING C", ["C"], [], ["A", "B"], False)
    assert got("ADD 1 TO N") == ("ADD", "ADD 1 TO N", ["N"], [], ["1"], True)
    assert got("COMPUTE X = (A + B) * 2.") == ("COMPUTE", "COMPUTE X = (A + B) * 2", ["X"], ["(A + B) * 2"], [], False)
    assert got("stop run.")[:2] == ("STOP", "STOP RUN") and got("GOBACK.")[0] == "GOBACK" and got("PERFORM A-1.")[:3] == ("PERFORM", "PERFORM A-1", ["A-1"])
    assert got("MOVE X.")[0] == "UNSUPPORTED_MOVE" and got("STOP 1.")[0] == "UNSUPPORTED_STOP" and cobol.statement(1, " ") is None
    s = cobol.statement(1, "EXEC SQL SELECT A, B INTO :W-A, :W-B FROM S.T1 JOIN T2 ON X = :K WHERE Y = :W-A END-EXEC.")
    assert (s.operation, s.tables, s.host_reads, s.host_writes) == ("SELECT", ["S.T1", "T2"], ["K"], ["W-A", "W-B"])
    s = cobol.statement(1, "EXEC CICS SEND MAP('M1') END-EXEC")
    assert (s.operation, s.resource, s.label) == ("SEND MAP", ("MAP", "M1"), "CICS SEND MAP MAP(M1)")
    assert cobol.statement(1, "EXEC CICS SYNCPOINT END-EXEC").resource == ("TRANSACTION", "SYNCPOINT") and cobol.statement(1, "EXEC CICS READ FILE(F) END-EXEC").resource == ("COMMAND", "UNKNOWN")


def test_declarations_and_headers():
    assert cobol.declaration("01 WS-A PIC S9(4)V99 VALUE -3.50.") == ("WS-A", ("S9(4)V99", "-3.50", 1))
    assert cobol.declaration('88 IS-OK VALUE "Y".') == ("IS-OK", ("", "Y", 88)) and cobol.declaration("01 G.") == ("G", ("", "", 1))
    assert cobol.declaration("05 N PIC 9 COMP-3.") is None and cobol.declaration("05 N OCCURS 3 TIMES.") is None and cobol.declaration("05 N PIC 9") is None
    assert cobol._Reader.header("MAIN-1. MOVE A TO B.", ()) == "MAIN-1" and cobol._Reader.header("MAIN-1.X", ()) is None and cobol._Reader.header("END-IF.", cobol.NO_PARAGRAPH) is None
    assert cobol.program_name(" program-id. ab-1.") == "AB-1" and cobol.program_name("PROGRAM-ID MISSING") is None


def test_calls_and_accesses():
    source = """
       SELECT IN-FILE ASSIGN TO "CUST.DATA".
       SELECT OUT-FILE ASSIGN TO OUT.F1.
      * CALL 'COMMENTED'.
       OPEN INPUT IN-FILE.
       CALL 'SUB-1' USING BY REFERENCE W-A, W-B BY CONTENT W-C.
       CALL WS-NEXT END-CALL.
       EXEC CICS LINK PROGRAM('PAY01')
           COMMAREA(W-AREA) END-EXEC.
       EXEC CICS XCTL PROGRAM(WS-TO) END-EXEC
       EXEC SQL
           DELETE FROM S.LEDGER
       END-EXEC.
       EXEC SQL SELECT A INTO :X FROM T1 JOIN T2 END-EXEC.
       REWRITE OUT-FILE. READ IN-FILE.
       DELETE OTHER.
    """
    source = "\n".join(x.strip() for x in source.split("\n"))
    assert list(calls.calls_of(source)) == [
        ("SUB-1", "COBOL_STATIC", False, ["W-A", "W-B", "W-C"], 6), ("WS-NEXT", "COBOL_DYNAMIC", True, [], 7),
        ("PAY01", "CICS_LINK", False, ["W-AREA"], 8), ("WS-TO", "CICS_XCTL", True, [], 10),
    ]
    assert list(calls.accesses_of(source)) == [
        ("DB2_TABLE", "S.LEDGER", "DELETE", "WRITE", 12), ("DB2_TABLE", "T1", "SELECT", "READ", 14), ("DB2_TABLE", "T2", "SELECT", "READ", 14),
        ("FILE_DATASET", "CUST.DATA", "OPEN INPUT", "READ", 5), ("FILE_DATASET", "OUT.F1", "REWRITE", "READ_WRITE", 15), ("FILE_DATASET", "OTHER", "DELETE", "READ_WRITE", 16),
    ]


def test_copybooks():
    library = {"REC": "01 REC-A PIC 9.\n    COPY INNER.", "INNER.CPY": "01 :P:-B PIC X."}
    lines = copybooks.expand("       COPY REC REPLACING ==:P:== BY ==WS==.", library)
    assert [x.text.strip() for x in lines] == ["01 REC-A PIC 9.", "01 WS-B PIC X."]
    assert lines[1].stack == ("REC", "INNER") and lines[1].number == 1
    with pytest.raises(copybooks.CopybookError, match="A -> B -> A"):
        copybooks.expand(" COPY A.", {"A": " COPY B.", "B": " COPY A."})


def test_job_cards():
    text = "//J1 JOB (1),CLASS=A\n//* note\n//S1 EXEC PGM=P1,\n//   COND=((4,LT),(8,GE,S0))\n//A DD DSN=IN.F,DISP=SHR\n//B DD DSN=&&T,DISP=(NEW,\n//   DELETE)\n//C DD SYSOUT=*\n//D DD DUMMY\n//S2 EXEC MYPROC\n"
    rows = jcl.rows_of("f", text)
    assert [(r[3], r[4], r[5]) for r in rows if r[6] is None] == [(None, None, None), ("S1", "P1", None), ("S2", None, "MYPROC")]
    assert rows[1][13] == [{"code": 4, "op": "LT", "step": ""}, {"code": 8, "op": "GE", "step": "S0"}]
    assert [(r[6], r[9], r[10]) for r in rows if r[6]] == [("A", "READ", False), ("B", "WRITE", True), ("C", "WRITE", False), ("D", "READ", False)]


@settings(max_examples=40, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.text(max_size=400), st.lists(st.sampled_from(["A.", "IF X = 1", "ELSE", "END-IF.", "MOVE 1 TO X.", "EXEC SQL", "END-EXEC.", "PERFORM A.", "STOP RUN."]), max_size=20))
def test_parsers_take_anything(noise, lines):
    cobol.program_rows(noise)
    cobol.program_rows("       PROCEDURE DIVISION.\n" + "\n".join("       " + x for x in lines))
    jcl.rows_of("f", noise)


def test_spectra():
    two = spectral.GraphField(list("abcdef"), list("abcdef"), list("bcaefd"), [2.0] * 6)
    values, _ = spectral.lowest(two.laplacian, 6)
    assert np.allclose(values, [0, 0, 3, 3, 3, 3]) and math.isclose(spectral.half_life(3.0), math.log(2) / 1.5)
    pair = spectral.GraphField(["a", "b"], ["a"], ["b"], [1.0])
    assert np.allclose(spectral.lowest(pair.normalised, 2)[0], [0, 2])
    line = spectral.GraphField([str(i) for i in range(8)], [str(i) for i in range(7)], [str(i + 1) for i in range(7)], [1.0] * 7)
    mass = spectral.impact(line, 0, 0.1)
    assert math.isclose(mass.sum(), 1.0, rel_tol=1e-9) and (mass >= 1e-3).sum() < 8
    assert math.isclose(spectral.personalised_rank(line, 0).sum(), 1.0, rel_tol=1e-9)
    exact = spectral.signature(line)[0]
    rough, error = spectral.signature(line, dense=1)
    assert np.all(np.abs(rough - exact) <= 5 * error + 0.3)
    n = 400
    path = spectral.GraphField([str(i) for i in range(n)], [str(i) for i in range(n - 1)], [str(i + 1) for i in range(n - 1)], [2.0] * (n - 1))
    got, _ = spectral.lowest(path.laplacian, 4, dense=10)
    assert np.allclose(got, 2 - 2 * np.cos(np.pi * np.arange(4) / n), atol=1e-7)


def test_fiedler_vectors():
    rng = np.random.default_rng(3)
    n = 2_100  # above the dense limit: two clusters with three bridges
    ids = [f"n{k:05d}" for k in range(n)]
    half = n // 2
    pairs = [(ids[k], ids[(k + 1) % half]) for k in range(half)] + [(ids[half + k], ids[half + (k + 1) % half]) for k in range(half)]
    pairs += [(ids[a], ids[b]) for base in (0, half) for a, b in (base + rng.integers(0, half, (4 * half, 2))) if a != b] + [(ids[7 * k], ids[half + 11 * k]) for k in range(3)]
    field = spectral.GraphField(ids, [a for a, _ in pairs], [b for _, b in pairs], [1.0] * len(pairs))
    v = spectral.fiedler_vector(field)
    exact = np.linalg.eigh(field.laplacian.dense())[1][:, 1]
    assert abs(v @ exact) > 1 - 1e-6 and len(set(np.sign(v[:half]))) == len(set(np.sign(v[half:]))) == 1
    apart = spectral.GraphField(list("abcdef"), list("abde"), list("bcef"), [1.0] * 4)
    got = spectral.fiedler_vector(apart)
    assert got[3:].tolist() == [-2.0] * 3 and np.allclose(np.abs(got[:3]), [2**-0.5, 0, 2**-0.5])


def test_cuts_of_two_clusters(spark):
    """Two chains of programs with one call between, a table on both sides: the best cut crosses that call."""
    calls = [("A1", "A2"), ("A2", "A3"), ("A1", "A3"), ("A3", "B1"), ("B1", "B2"), ("B2", "B3"), ("B1", "B3")]
    rows = [(f"PGM:{a}", f"PGM:{b}", "CALL_DYNAMIC" if (a, b) == ("A3", "B1") else "CALL_RESOLVED", 1.0, "OBSERVED") for a, b in calls]
    edges = spark.createDataFrame(rows, "src string, dst string, edge_type string, w double, status string")
    nodes = edges.selectExpr("src id").union(edges.selectExpr("dst")).distinct().selectExpr("id", "'program' node_type")
    best = portfolio.partitions(nodes, edges).where("cut_no = 1").first()
    assert (best.cut, best.crossing, best.programs_a, best.programs_b, best.tx_violations, best.uncertainty) == (1.0, 1, 3, 3, 0, 1.0)
    assert portfolio.call_cycles(edges).isEmpty()
    loop = edges.union(spark.createDataFrame([("PGM:B3", "PGM:B1", "CALL_RESOLVED", 1.0, "OBSERVED")], edges.schema))
    assert {(r.id, r["size"]) for r in portfolio.call_cycles(loop).collect()} == {("PGM:B1", 3), ("PGM:B2", 3), ("PGM:B3", 3)}


def test_slices_and_idioms(programs):
    nodes, edges = control_flow.nodes(programs), control_flow.edges(programs)
    seeds = slicing.find_seeds(nodes.where("program = 'till'"), variable="WS-STATE")
    assert seeds.first().seed == "MAIN-LINE:L12_IF"
    rows = slicing.bounded(nodes, edges, seeds, max_nodes=3).orderBy("rank").collect()
    assert rows[0].id == "MAIN-LINE:L12_IF" and sum(r.included for r in rows) == 3 and len(rows) > 3
    assert {(r.program, r.idiom) for r in idioms.mine(nodes, edges).collect()} >= {("till", "TERMINAL_GOBACK_GUARD")}
