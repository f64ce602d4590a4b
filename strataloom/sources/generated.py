"""Generated programs and jobs, one per supplier and order: text for the source operators at any scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.sources import star


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(program, source): a small batch program whose branches, calls and tables depend on its supplier."""
    s = star.table(spark, sf_dir, "supplier")
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    name = F.concat(F.lit("PGM"), F.lpad(k.cast("string"), 6, "0"))
    other = F.concat(F.lit("PGM"), F.lpad(((k * 7 + 3) % 97).cast("string"), 6, "0"))
    rows = [
        F.lit("IDENTIFICATION DIVISION."), F.concat(F.lit("PROGRAM-ID. "), name, F.lit(".")), F.lit("DATA DIVISION."), F.lit("WORKING-STORAGE SECTION."),
        F.concat(F.lit("01 WS-BALANCE PIC 9(7)V99 VALUE "), F.format_string("%d.00", F.abs(F.round("s_acctbal")).cast("long")), F.lit(".")),
        F.concat(F.lit("01 WS-LIMIT PIC 9(5) VALUE "), (n * 100).cast("string"), F.lit(".")),
        F.lit("01 WS-COUNT PIC 9(3) VALUE 0."), F.lit('01 WS-STATUS PIC X(4) VALUE "INIT".'),
        F.lit("PROCEDURE DIVISION."), F.lit("0000-MAIN."), F.lit("    MOVE 1 TO WS-COUNT."), F.lit('    MOVE "OPEN" TO WS-STATUS.'),
        F.lit("    PERFORM 1000-CHECK."), F.lit('    IF WS-STATUS = "FAIL" OR WS-BALANCE < WS-LIMIT'), F.lit("        PERFORM 3000-ERROR"), F.lit("    ELSE"),
        F.lit("        PERFORM 2000-POST"), F.lit("    END-IF."), F.lit("    STOP RUN."), F.lit("1000-CHECK."),
        F.when(n % 3 == 0, "    EXEC SQL SELECT BAL INTO :WS-BALANCE FROM ACCOUNTS END-EXEC.").otherwise("    ADD 10 TO WS-BALANCE."),
        F.lit("    IF WS-BALANCE IS GREATER THAN WS-LIMIT"), F.lit('        MOVE "OKAY" TO WS-STATUS'), F.lit("    ELSE"), F.lit('        MOVE "FAIL" TO WS-STATUS'), F.lit("    END-IF."),
        F.lit("2000-POST."), F.lit("    SUBTRACT WS-LIMIT FROM WS-BALANCE."),
        F.when(k % 2 == 0, F.concat(F.lit("    CALL '"), other, F.lit("' USING WS-BALANCE WS-STATUS."))).otherwise("    EXEC SQL UPDATE LEDGER SET AMOUNT = :WS-BALANCE END-EXEC."),
        F.when(n % 5 == 0, "    PERFORM 2000-POST.").otherwise("    COMPUTE WS-COUNT = WS-COUNT + 1."),
        F.lit("3000-ERROR."), F.lit("    MOVE 9 TO WS-COUNT."), F.lit("    DISPLAY WS-STATUS."),
    ]
    lines = F.array_join(F.transform(F.array(*rows), lambda x: F.concat(F.lit("       "), x)), "\n")
    return s.select(name.alias("program"), lines.alias("source"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_file, text): a job per order, a step per line of it."""
    step = star.steps(spark, sf_dir)
    pgm = F.concat(F.lit("PGM"), F.lpad(F.col("program").cast("string"), 6, "0"))
    card = F.concat(
        F.format_string("//S%03d EXEC PGM=", F.col("step").cast("int")), pgm, F.lit(",\n//   COND=(4,LT)\n//IN   DD DSN=IN.F"), (F.col("program") % 7).cast("string"),
        F.lit(",DISP=SHR\n//OUT  DD DSN=OUT.F"), (F.col("program") % 5).cast("string"), F.lit(",DISP=(NEW,CATLG)"),
    )
    rows = step.groupBy("job").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", card.alias("c")))), lambda x: x["c"]), "\n").alias("body"))
    name = F.concat(F.lit("J"), F.lpad(F.col("job").cast("string"), 7, "0"))
    return rows.select(F.concat(name, F.lit(".jcl")).alias("job_file"), F.concat(F.lit("//"), name, F.lit(" JOB (ACCT),CLASS=A\n"), "body").alias("text"))


def estate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, bytes, text): the programs, each with a COPY of one of seven members, five of which are there, and the jobs as files."""
    copy = F.concat(F.lit("\n       COPY REC"), (F.substring("program", 4, 6).cast("int") % 7).cast("string"), F.lit("."))
    sources = programs(spark, sf_dir).select(F.concat(F.lit("cbl/"), "program", F.lit(".cbl")).alias("path"), F.concat("source", copy).alias("text"))
    member = F.concat(F.lit("REC"), F.col("id").cast("string"))
    members = spark.range(5).select(F.concat(F.lit("cpy/"), member, F.lit(".cpy")).alias("path"), F.concat(F.lit("       01 "), member, F.lit(" PIC X.")).alias("text"))
    cards = jobs(spark, sf_dir).select(F.concat(F.lit("jcl/"), "job_file").alias("path"), "text")
    return sources.union(members).union(cards).select("path", F.octet_length("text").cast("long").alias("bytes"), "text")
