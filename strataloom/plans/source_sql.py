"""DuckDB SQL for the generated programs and jobs: what they contain is stated statement by statement."""

from __future__ import annotations

from strataloom.sources import star

#: One row per generated program; a, b, c say which of its variable statements it has.
PROGRAMS = """x_pgm as (select 'PGM' || lpad(s_suppkey::varchar, 6, '0') program, s_suppkey k, s_nationkey n, abs(round(s_acctbal))::bigint balance,
  s_nationkey % 3 = 0 a, s_suppkey % 2 = 0 b, s_nationkey % 5 = 0 c, 'PGM' || lpad(((s_suppkey * 7 + 3) % 97)::varchar, 6, '0') callee from supplier)"""

#: (order, paragraph, line, kind, type, code, reads, writes, table, condition) of every statement.
STATEMENTS = [
    (0, "0000-MAIN", 11, "MOVE", "stmt", "MOVE 1 TO WS-COUNT", "", "WS-COUNT", "", ""),
    (1, "0000-MAIN", 12, "MOVE", "stmt", 'MOVE "OPEN" TO WS-STATUS', "", "WS-STATUS", "", ""),
    (2, "0000-MAIN", 13, "PERFORM", "perform", "PERFORM 1000-CHECK", "", "", "", ""),
    (3, "0000-MAIN", 14, "IF", "branch", 'IF (WS-STATUS = "FAIL" OR WS-BALANCE < WS-LIMIT)', "WS-BALANCE,WS-LIMIT,WS-STATUS", "", "", ""),
    (4, "0000-MAIN", 15, "PERFORM", "perform", "PERFORM 3000-ERROR", "", "", "", ""),
    (5, "0000-MAIN", 17, "PERFORM", "perform", "PERFORM 2000-POST", "", "", "", ""),
    (6, "0000-MAIN", 19, "STOP", "stop", "STOP RUN", "", "", "", ""),
    (7, "1000-CHECK", 21, "EXECSQL", "db_access", "EXEC SQL SELECT BAL INTO :WS-BALANCE FROM ACCOUNTS END-EXEC", "", "WS-BALANCE", "ACCOUNTS", "a"),
    (7, "1000-CHECK", 21, "ADD", "stmt", "ADD 10 TO WS-BALANCE", "WS-BALANCE", "WS-BALANCE", "", "not a"),
    (8, "1000-CHECK", 22, "IF", "branch", "IF WS-BALANCE > WS-LIMIT", "WS-BALANCE,WS-LIMIT", "", "", ""),
    (9, "1000-CHECK", 23, "MOVE", "stmt", 'MOVE "OKAY" TO WS-STATUS', "", "WS-STATUS", "", ""),
    (10, "1000-CHECK", 25, "MOVE", "stmt", 'MOVE "FAIL" TO WS-STATUS', "", "WS-STATUS", "", ""),
    (11, "2000-POST", 28, "SUBTRACT", "stmt", "SUBTRACT WS-LIMIT FROM WS-BALANCE", "WS-BALANCE,WS-LIMIT", "WS-BALANCE", "", ""),
    (12, "2000-POST", 29, "UNSUPPORTED_CALL", "unsupported_stmt", "CALL '@' USING WS-BALANCE WS-STATUS", "WS-BALANCE,WS-STATUS", "", "", "b"),
    (12, "2000-POST", 29, "EXECSQL", "db_access", "EXEC SQL UPDATE LEDGER SET AMOUNT = :WS-BALANCE END-EXEC", "WS-BALANCE", "", "LEDGER", "not b"),
    (13, "2000-POST", 30, "PERFORM", "perform", "PERFORM 2000-POST", "", "", "", "c"),
    (13, "2000-POST", 30, "COMPUTE", "stmt", "COMPUTE WS-COUNT = WS-COUNT + 1", "WS-COUNT", "WS-COUNT", "", "not c"),
    (14, "3000-ERROR", 32, "MOVE", "stmt", "MOVE 9 TO WS-COUNT", "", "WS-COUNT", "", ""),
    (15, "3000-ERROR", 33, "UNSUPPORTED_DISPLAY", "unsupported_stmt", "DISPLAY WS-STATUS", "WS-STATUS", "", "", ""),
]
#: (from, to, type, condition) of the control edges, by the order of the statements.
CONTROL = [
    (0, 1, "cfg_seq", ""), (1, 2, "cfg_seq", ""), (2, 3, "cfg_seq", ""), (3, 4, "cfg_branch_true", ""), (3, 5, "cfg_branch_false", ""), (4, 6, "cfg_seq", ""), (5, 6, "cfg_seq", ""),
    (7, 8, "cfg_seq", ""), (8, 9, "cfg_branch_true", ""), (8, 10, "cfg_branch_false", ""), (11, 12, "cfg_seq", ""), (12, 13, "cfg_seq", ""), (14, 15, "cfg_seq", ""),
    (2, 7, "cfg_call", ""), (4, 14, "cfg_call", ""), (5, 11, "cfg_call", ""), (13, 11, "cfg_call", "c"),
    (9, 3, "cfg_return", ""), (10, 3, "cfg_return", ""), (15, 6, "cfg_return", ""), (13, 6, "cfg_return", ""),
    (9, 11, "cfg_fallthrough", ""), (10, 11, "cfg_fallthrough", ""), (13, 14, "cfg_fallthrough", ""),
]
#: Weight and label of the control edges.
LABELS = {"cfg_seq": (1.0, "seq"), "cfg_branch_true": (1.0, "true"), "cfg_branch_false": (1.0, "false"), "cfg_call": (1.5, "call"), "cfg_return": (1.2, "return"), "cfg_fallthrough": (0.8, "fallthrough")}


def _when(condition: str) -> str:
    return f" where {condition}" if condition else ""


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _statement(s: tuple) -> str:
    at, paragraph, line, kind, type_, code, reads, writes, table, condition = s
    code = f"replace({_text(code)}, '@', callee)" if "@" in code else _text(code)
    return f"select program, {at} pos, '{paragraph}:L{line}_{kind}' id, '{type_}' node_type, '{paragraph}' paragraph, {code} code, '{reads}' reads, '{writes}' writes, {line} line, '{table}' tables from x_pgm{_when(condition)}"


STATED = "x_stmt as (" + " union all ".join(map(_statement, STATEMENTS)) + ")"
NODES = f"""{STATED}, x_node as (select * from x_stmt union all
  select distinct program, 99, 'db_table:' || tables, 'db_table', 'DATABASE', 'TABLE ' || tables, '', '', 0, '' from x_stmt where tables <> '')"""
_control = " union all ".join(f"select program, {a} f, {b} t, '{kind}' edge_type, {LABELS[kind][0]}::double weight, '{LABELS[kind][1]}' label from x_pgm{_when(c)}" for a, b, kind, c in CONTROL)
EDGES = f"""{NODES}, x_ctl as ({_control}),
x_read as (select program, id, unnest(string_split(reads, ',')) var from x_stmt where reads <> ''), x_write as (select program, id, unnest(string_split(writes, ',')) var from x_stmt where writes <> ''),
x_edge as (select x_ctl.program, s.id src, d.id dst, edge_type, weight, label from x_ctl join x_stmt s on s.program = x_ctl.program and s.pos = f join x_stmt d on d.program = x_ctl.program and d.pos = t
  union all select program, w.id, r.id, 'dfg_def_use', 1.0, 'def_use(' || var || ')' from x_write w join x_read r using (program, var) where w.id <> r.id
  union all select program, 'db_table:' || tables, id, 'dfg_db_read', 1.3, 'read(' || tables || ')' from x_stmt where tables <> ''
  union all select program, id, 'db_table:' || tables, 'dfg_db_write', 1.6, 'write(' || tables || ')' from x_stmt where tables = 'LEDGER')"""

#: Runs: the balance after the check decides; programs with c call themselves for ever once they post.
RUNS = """x_case as (select *, unnest([{'case_id': 'base', 'start': balance}, {'case_id': 'poor', 'start': 5}, {'case_id': 'rich', 'start': 99999}]) s from x_pgm),
x_run as (select program, a, c, s.case_id case_id, s.start + (case when a then 0 else 10 end) > n * 100 paid from x_case)"""

#: The portfolio's edges.
PORTFOLIO = f"""{star.SQL.strip()}, {PROGRAMS},
x_step as (select 'J' || lpad(job::varchar, 7, '0') job, 'S' || lpad(step::varchar, 3, '0') step, step pos, program k, 'PGM' || lpad(program::varchar, 6, '0') program from steps),
x_before as (select *, lag(step) over (partition by job order by pos) before from x_step),
x_call as (select program, callee, callee in (select program from x_pgm) known from x_pgm where b),
x_e as (
  select 'JOB:' || job src, 'STEP:' || job || '.' || step dst, 'JOB_STEP' edge_type, 'CONTAINS' label, 'OBSERVED' status from x_step
  union all select 'STEP:' || job || '.' || before, 'STEP:' || job || '.' || step, 'STEP_SEQUENCE', 'NEXT', 'OBSERVED' from x_before where before is not null
  union all select 'STEP:' || job || '.' || step, 'PGM:' || program, 'STEP_EXEC', 'EXEC ' || program, 'OBSERVED' from x_step
  union all select 'STEP:' || job || '.' || step, 'DSN:IN.F' || (k % 7), 'STEP_READ_DSN', 'DD:IN (READ)', 'OBSERVED' from x_step
  union all select 'STEP:' || job || '.' || step, 'DSN:OUT.F' || (k % 5), 'STEP_WRITE_DSN', 'DD:OUT (WRITE)', 'OBSERVED' from x_step
  union all select 'PGM:' || program, case when known then 'PGM:' else 'EXT_PGM:' end || callee, case when known then 'CALL_RESOLVED' else 'CALL_UNRESOLVED' end,
    case when known then 'CALL ' else 'CALL_UNRESOLVED ' end || callee, case when known then 'OBSERVED' else 'UNRESOLVED' end from x_call
  union all select 'PGM:' || program, 'TABLE:ACCOUNTS', 'PGM_SQL_READ', 'SQL SELECT', 'OBSERVED' from x_pgm where a
  union all select 'PGM:' || program, 'TABLE:LEDGER', 'PGM_SQL_WRITE', 'SQL UPDATE', 'OBSERVED' from x_pgm where not b),
x_id as (select 'PGM:' || program id from x_pgm union select 'JOB:' || job from x_step union select src from x_e union select dst from x_e),
x_n as (select id, case split_part(id, ':', 1) when 'PGM' then 'program' when 'EXT_PGM' then 'external_program' when 'JOB' then 'job' when 'STEP' then 'step' when 'DSN' then 'dataset' when 'TABLE' then 'db2_table' end node_type from x_id)"""

SQL = {
    "p2_program_id": f"with {PROGRAMS} select program, program program_id from x_pgm",
    "p3_variables": f"""with {PROGRAMS} select program, v.name, v.pic, v.value initial_value, 1 as level from (select program, unnest([{{'name': 'WS-BALANCE', 'pic': '9(7)V99', 'value': balance || '.00'}},
        {{'name': 'WS-LIMIT', 'pic': '9(5)', 'value': (n * 100)::varchar}}, {{'name': 'WS-COUNT', 'pic': '9(3)', 'value': '0'}}, {{'name': 'WS-STATUS', 'pic': 'X(4)', 'value': 'INIT'}}]) v from x_pgm)""",
    "p4_paragraphs": f"""with {PROGRAMS}, {STATED}, x_p as (select paragraph, min(pos) first from x_stmt group by 1)
        select program, (row_number() over (partition by program order by first) - 1)::int seq, p.paragraph "name", s.id entry,
        coalesce((select string_agg(e.id, ',' order by e.pos) from x_stmt e where e.program = s.program and e.paragraph = p.paragraph and e.pos in (9, 10, 13, 15)), '') exits
        from x_p p join x_stmt s on s.paragraph = p.paragraph and s.pos = p.first""",
    "p5_statements": f"with {PROGRAMS}, {NODES} select program, id, node_type, paragraph, code, reads, writes, line, tables from x_node",
    "g15_program_graph": f"with {PROGRAMS}, {EDGES} select * from x_edge",
    "j2_calls": f"with {PROGRAMS}, {EDGES} select program, src, dst from x_edge where edge_type = 'cfg_call'",
    "j3_returns": f"with {PROGRAMS}, {EDGES} select program, src, dst from x_edge where edge_type = 'cfg_return'",
    "j4_fallthrough": f"with {PROGRAMS}, {EDGES} select program, src, dst from x_edge where edge_type = 'cfg_fallthrough'",
    "j5_variable_edges": f"with {PROGRAMS}, {EDGES} select program, 'var_' || var src, id dst, 'dfg_read' edge_type from x_read union all select program, id, 'var_' || var, 'dfg_write' from x_write",
    "g7_cycles": f"""with {PROGRAMS} select program, c::int n_sccs, 0 n_trapped, c::int n_cycles, false budget_exhausted, c recursive, false invariant_hazard, false deadlock, true reaches_terminal,
        case when c then 'POTENTIAL_RECURSION' else 'DIRECTED_ACYCLIC_FLOW' end verdict from x_pgm""",
    "x10_idioms": f"""with {PROGRAMS}, {STATED}, x_i(idiom, pos, needs_table) as (values ('CENTRALIZED_ERROR_PARAGRAPH', 14, false), ('DEFENSIVE_STATUS_CHECK', 7, true), ('INITIALIZATION_AT_ENTRY', 0, false), ('TERMINAL_GOBACK_GUARD', 6, false))
        select program, idiom, 1 instances, id anchors from x_i join x_stmt using (pos) where not needs_table or tables <> ''""",
    "x8_graph_digests": f"""with {PROGRAMS}, {EDGES}, x_row as (select program, 'n|' || id || '|' || node_type r from x_node union all select program, 'e|' || src || '|' || dst || '|' || edge_type || '|' || weight::varchar from x_edge)
        select program, sha256(array_to_string(list_sort(list(r)), chr(10))) digest from x_row group by 1""",
    "x1_runs": f"with {PROGRAMS}, {RUNS} select program, case_id, case when paid and c then 500 when paid then 12 else 11 end steps, paid and c timed_out, 4 n_vars from x_run",
    "x5_equivalence": f"with {PROGRAMS}, {RUNS} select program, case_id, case when paid and c then 'TIMEOUT' when not paid then 'INVARIANT_VIOLATION' when a then 'PASS' else 'DIVERGED' end status from x_run",
    "a15_equivalence": f"""with {PROGRAMS}, {RUNS}, x_v as (select program, count(*) n, count(*) filter (paid and not c and a) passed from x_run group by 1)
        select program, n, passed, round(passed / n, 6) rate, case when passed = n then 'OBSERVED_VERIFIED' else 'OBSERVED_DIVERGED' end status from x_v""",
    "x7_findings": f"""with {PROGRAMS}, {STATED} select program, 'unsupported:' || id id, 'unsupported_statement' kind, 'coverage_gap' severity, id nodes, line from x_stmt where node_type = 'unsupported_stmt'
        union all select program, 'cycle:1', 'reported_control_flow_cycle', 'review', string_agg(id, ',' order by pos), null from x_stmt where pos in (11, 12, 13) and program in (select program from x_pgm where c) group by 1""",
    "x7_metrics": f"""with {PROGRAMS}, {EDGES}, x_u as (select program, count(*) u from x_stmt where node_type = 'unsupported_stmt' group by 1),
        x_n as (select program, count(*) + 4 n from x_node group by 1), x_m as (select program, count(*) m from (select program from x_edge union all select program from x_read union all select program from x_write) group by 1),
        x_all as (select p.program, u, x_n.n, m, c::int c from x_pgm p join x_u using (program) join x_n using (program) join x_m using (program))
        select program, unnest(['parser_coverage_ratio', 'unsupported_statement_count', 'graph_node_count', 'graph_edge_count', 'enumerated_cycle_count', 'non_trivial_scc_count', 'trapped_scc_count', 'reaches_terminal']) metric,
        unnest([round((16 - u) / 16, 4), u, n, m, c, c, 0, 1]::double[]) "value" from x_all""",
    "a11_finding_counts": f"""with {PROGRAMS}, {STATED} select 'unsupported_statement' kind, count(*) n from x_stmt where node_type = 'unsupported_stmt' having count(*) > 0
        union all select 'reported_control_flow_cycle', count(*) from x_pgm where c having count(*) > 0""",
    "a10_verb_histogram": f"with {PROGRAMS} select 'DISPLAY' verb, count(*) n from x_pgm having count(*) > 0 union all select 'CALL', count(*) from x_pgm where b having count(*) > 0",
    "p16_accesses": f"""with {PROGRAMS} select program, 'DB2_TABLE' resource_type, 'ACCOUNTS' resource, 'SELECT' operation, 'READ' "mode", 21 line from x_pgm where a
        union all select program, 'DB2_TABLE', 'LEDGER', 'UPDATE', 'WRITE', 29 from x_pgm where not b""",
    "s6_job_cards": f"""with recursive {PORTFOLIO}, x_seq as (select *, row_number() over (partition by job order by pos) seq from x_step)
        select job || '.jcl' job_file, job, null::int step_seq, null step, null program, null dd, null dsn, null disp, null intent, 1 line, '' conditions from (select distinct job from x_step)
        union all select job || '.jcl', job, seq, step, program, null, null, null, null, 4 * seq - 2, '4 LT' from x_seq
        union all select job || '.jcl', job, seq, step, program, 'IN', 'IN.F' || (k % 7), 'SHR', 'READ', 4 * seq, '' from x_seq
        union all select job || '.jcl', job, seq, step, program, 'OUT', 'OUT.F' || (k % 5), '(NEW,CATLG)', 'WRITE', 4 * seq + 1, '' from x_seq""",
    "g12_portfolio": f"with recursive {PORTFOLIO} select src, dst, edge_type, 1.0::double w, label, status from x_e",
    "a5_type_counts": f"with recursive {PORTFOLIO} select 'node' what, node_type type, count(*) n from x_n group by 2 union all select 'edge', edge_type, count(*) from x_e group by 2",
    "w5_step_sequence": f"with recursive {PORTFOLIO} select src, dst from x_e where edge_type = 'STEP_SEQUENCE'",
    "j8_step_programs": f"with recursive {PORTFOLIO} select src, dst from x_e where edge_type = 'STEP_EXEC'",
    "j9_resource_map": f"""with recursive {PORTFOLIO}, x_run as (select src step, dst program from x_e where edge_type = 'STEP_EXEC')
        select src program, dst resource, 'table' kind from x_e where starts_with(edge_type, 'PGM_') union select program, dst, 'dataset' from x_e join x_run on src = step where edge_type in ('STEP_READ_DSN', 'STEP_WRITE_DSN')
        union select program, src, 'job' from x_e join x_run on dst = step where edge_type = 'JOB_STEP'""",
    "g14_portfolio_metrics": f"""with recursive {PORTFOLIO} select (select count(*) from x_n) nodes, (select count(*) from x_n where node_type = 'program') programs, (select count(*) from x_n where node_type = 'external_program') external_programs,
        (select count(*) from x_n where node_type = 'job') jobs, (select count(*) from x_n where node_type = 'step') steps, (select count(*) from x_n where node_type = 'dataset') datasets, (select count(*) from x_n where node_type = 'db2_table') db2_tables,
        (select count(*) from x_e) edges, count(*) total, count(*) filter (known) resolved, count(*) filter (not known) as unresolved, 0 as dynamic, case when count(*) > 0 then round(count(*) filter (known) / count(*), 4) else 1.0 end ratio from x_call""",
    "g14_portfolio_report": f"""with recursive {PORTFOLIO}, x_c as (select distinct src, dst from x_e where edge_type = 'CALL_RESOLVED'), x_go as (select src seed, dst id from x_c union select seed, dst from x_go join x_c on src = id),
        x_use as (select src step, dst program from x_e where edge_type = 'STEP_EXEC'),
        x_acc as (select src program, dst resource, 2 points from x_e where starts_with(edge_type, 'PGM_') union select program, dst, 1 from x_e join x_use on src = step where edge_type in ('STEP_READ_DSN', 'STEP_WRITE_DSN')),
        x_pts as (select a.program a, b.program b, a.points p from x_acc a join x_acc b on a.resource = b.resource and a.program < b.program union all select least(src, dst), greatest(src, dst), 1 from x_c where src <> dst)
        select 'coupling' "section", a subject, b other, sum(p)::double "value" from x_pts group by 2, 3
        union all select 'impact', id, null, (select count(*) from x_go where seed = x_n.id and x_go.id <> seed)::double from x_n where node_type = 'program'
        union all select 'cycle', a.seed, min(a.id), count(*)::double from x_go a join x_go b on a.seed = b.id and a.id = b.seed group by 2""",
    "g11_call_cycles": f"""with recursive {PORTFOLIO}, x_c as (select src, dst from x_e where edge_type = 'CALL_RESOLVED'), x_r as (select src seed, dst id from x_c union select seed, dst from x_r join x_c on src = id)
        select id, scc, count(*) over (partition by scc) size from (select a.seed id, min(a.id) scc from x_r a join x_r b on a.seed = b.id and a.id = b.seed group by 1)""",
    "s2_classify": f"""with recursive {PORTFOLIO} select 'cbl/' || program || '.cbl' path, 'COBOL' kind, program detected_id from x_pgm union all select 'cpy/REC' || r || '.cpy', 'COPYBOOK', 'REC' || r from range(5) t(r)
        union all select 'jcl/' || job || '.jcl', 'JCL', job from (select distinct job from x_step)""",
    "s3_references": f"""with recursive {PORTFOLIO} select 'cbl/' || program || '.cbl' path, 'table' kind, 'ACCOUNTS' reference from x_pgm where a union all select 'cbl/' || program || '.cbl', 'table', 'LEDGER' from x_pgm where not b
        union all select 'cbl/' || program || '.cbl', 'copybook', 'REC' || (k % 7) from x_pgm
        union all select distinct 'jcl/' || job || '.jcl', 'dataset', 'IN.F' || (k % 7) from x_step union all select distinct 'jcl/' || job || '.jcl', 'dataset', 'OUT.F' || (k % 5) from x_step""",
    "u3_unresolved": f"with {PROGRAMS} select 'cbl/' || program || '.cbl' path, 'REC' || (k % 7) copybook from x_pgm where k % 7 >= 5",
    "t1_rate_limit": """with recursive e as (select user_id::varchar as key, event_id, epoch_us(ts) / 1e6 "at", row_number() over (partition by user_id order by ts, event_id) k from events),
        r as (select key, 0::bigint k, []::double[] h, 0::bigint event_id, 0::double "at", false allowed from (select distinct key from e)
        union all select e.key, e.k, case when len(list_filter(h, lambda t: t > e."at" - 3600)) < 3 then list_append(list_filter(h, lambda t: t > e."at" - 3600), e."at") else list_filter(h, lambda t: t > e."at" - 3600) end,
        e.event_id, e."at", len(list_filter(h, lambda t: t > e."at" - 3600)) < 3 from r join e on e.key = r.key and e.k = r.k + 1) select key, event_id, "at", allowed from r where k > 0""",
    "s12_compressed_rows": f"""with recursive {star.SQL.strip()}, x_i as (select id, row_number() over (order by id) - 1 i from programs)
        select s.i::int i, string_agg(d.i::varchar, ',' order by d.i) columns, string_agg(w::varchar, ',' order by d.i) "values" from calls join x_i s on s.id = src join x_i d on d.id = dst group by 1""",
}
