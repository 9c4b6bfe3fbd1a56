"""Runs that are broken off and taken up again, sinks that may be written twice, and pools of calls."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from quillspark.functions.calls import asked, in_order
from quillspark.operators import dots, review
from quillspark.plans import pipelines, runs
from quillspark.sources import files, sinks


class Killed(RuntimeError):
    pass


def steps_of(fail):
    """Two steps; `fail` breaks off the run in one of them, before or after its rows are written."""

    def first(rows):
        return rows.withColumn("a", F.col("k") * 2)

    def second(rows):
        if fail == "between":
            raise Killed
        out = rows.select("k", F.explode(F.array(F.lit(1), F.lit(2))).alias("n"), "a")
        return out.withColumn("a", F.when(F.lit(fail == "within") & (F.col("k") == 3), F.raise_error(F.lit("killed"))).otherwise(F.col("a")))

    return [("one", first), ("two", second)]


@pytest.mark.parametrize("fail", ["between", "within", "manifest"])
def test_a_killed_run_gives_the_same_tables_once(spark, tmp_path, monkeypatch, fail):
    inputs = spark.range(6).select(F.col("id").alias("k"))
    whole = runs.work_off(spark, f"file://{tmp_path}/whole", inputs, "k", steps_of(None))
    want = sorted(tuple(r) for r in whole["two"].rows().select("k", "n", "a").collect())
    folder = f"file://{tmp_path}/{fail}"
    if fail == "manifest":
        real = runs.Stage.commit

        def commit(self, keys, rows, batch=None):
            rows.write.mode("overwrite").parquet(f"{self.at}/batch=0")
            raise Killed

        monkeypatch.setattr(runs.Stage, "commit", commit)
        with pytest.raises(Killed):
            runs.work_off(spark, folder, inputs, "k", steps_of(None))
        monkeypatch.setattr(runs.Stage, "commit", real)
    else:
        with pytest.raises(Exception):  # noqa: B017
            runs.work_off(spark, folder, inputs, "k", steps_of(fail))
        assert runs.Stage(spark, folder, "one", "k").batches() == [0] and runs.Stage(spark, folder, "two", "k").batches() == []
    for _ in range(2):
        got = runs.work_off(spark, folder, inputs, "k", steps_of(None))
        assert sorted(tuple(r) for r in got["two"].rows().select("k", "n", "a").collect()) == want
        assert [s.batches() for s in got.values()] == [[0], [0]]


def test_new_inputs_and_forced_ones(spark, tmp_path):
    at = f"file://{tmp_path}/run"
    rows = spark.range(4).select(F.col("id").alias("k"))
    runs.work_off(spark, at, rows, "k", steps_of(None))
    done = runs.work_off(spark, at, rows.union(spark.range(9, 10)), "k", steps_of(None))
    assert {(r.k, r.batch) for r in done["two"].rows().collect()} == {(0, 0), (1, 0), (2, 0), (3, 0), (9, 1)}
    steps = [steps_of(None)[0], ("two", lambda x: x.filter("k <> 1").select("k", F.lit(7).alias("n"), "a"))]
    forced = runs.work_off(spark, at, rows.union(spark.range(9, 10)), "k", steps, force="two")
    assert {(r.k, r.n, r.batch) for r in forced["two"].rows().collect()} == {(k, 7, 2) for k in (0, 2, 3, 9)} and forced["one"].batches() == [0, 1]
    # an input that gave no rows is done, too
    assert forced["two"].open(rows).count() == 0


def test_append_once(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = lambda *r: spark.createDataFrame(list(r), "input string, n int")
    sinks.append_once(rows(("a", 2), ("a", 1), (None, 5)), path, "input", 0)
    for _ in range(3):
        out = sinks.append_once(rows(("a", 0), ("b", 3), ("b", 4), (None, 6)), path, "input", 1)
    assert sorted(map(tuple, out.collect()), key=str) == [("a", 1, 0), ("b", 3, 1), (None, 5, 0)]


def test_files_of_other_names_stay(spark, tmp_path):
    at = f"file://{tmp_path}/texts"
    rows = lambda *r: spark.createDataFrame(list(r), "name string, t string, patched string")
    sinks.text_files(rows(("a b", "1", None), ("가", "2", None)), at, "name", "t")
    sinks.text_files(rows(("가", "3", None)), at, "name", "t")
    read = lambda: {r.name: r.value for r in spark.read.text(at, wholetext=True).collect()}
    assert read() == {"a b": "1\n", "가": "3\n"}
    pages = spark.createDataFrame([("가", "x", "x"), ("c", "x", "y"), ("d", "x", None)], "name string, text string, patched string")
    assert sinks.restored_files(pages, at, "name") == 1 and read() == {"a b": "1\n", "c": "y\n"}
    assert sinks.restored_files(pages, at, "name") == 0 and read() == {"a b": "1\n", "c": "y\n"}


def test_counters_are_taken_in_the_writing(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            calls.add(len(b))
            yield b

    rows = spark.range(50).mapInPandas(seen, "id long")
    got = sinks.counted(rows, f"file://{tmp_path}/o", {"n": F.count("*"), "top": F.max("id")})
    assert got == {"n": 50, "top": 49} and calls.value == 50 and spark.read.parquet(f"file://{tmp_path}/o").count() == 50


def test_broken_cases_are_kept_apart(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "input": "x"}\n{"id": "2", "inp\nnonsense\n{"id": "3", "must": ["y"]}\n')
    good, bad = files.case_lines(spark, f"file://{tmp_path}/a.jsonl")
    assert sorted(r.id for r in good.collect()) == ["1", "3"]
    assert sorted((r.line, r.file) for r in bad.collect()) == [("nonsense", "a.jsonl"), ('{"id": "2", "inp', "a.jsonl")]
    (tmp_path / "b.json").write_text('[{"id": "1", "input": ')
    assert files.cases(spark, f"file://{tmp_path}/b.json").count() == 0 and files.broken(spark, f"file://{tmp_path}/b.json").first().file == "b.json"


def test_calls_in_order_within_a_deadline():
    running, most, lock = [0], [0], threading.Lock()

    def call(k):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep(2 if k == 3 else 0.01 * (5 - k % 5))
        with lock:
            running[0] -= 1
        if k == 5:
            raise OSError("busy")
        return k

    began = time.monotonic()
    got = list(in_order([lambda k=k: call(k) for k in range(12)], at_once=3, deadline=0.5))
    assert [a for a, _ in got] == [None if k in (3, 5) else k for k in range(12)]
    assert got[3][1] == "no answer in 0.5 s" and got[5][1] == "OSError: busy" and most[0] <= 4 and time.monotonic() - began < 1.9


@pytest.fixture
def service():
    class Service:
        """Answers by what it is asked: with a finding, with a list, late, or not at all."""

        def json(self, system, user, temperature=None):
            if "slow" in user:
                time.sleep(3)
            if "down" in user:
                raise OSError("HTTP 500")
            return [] if "list" in user else {"findings": [{"explanation": "why", "speech_quote": "x"}], "numbers": [{"number": "0.3", "period": "3", "evidence": "0.333"}]}

    return Service


def test_judge_is_called(spark, service):
    pages = spark.createDataFrame([(1, "say x"), (2, "down"), (3, "list"), (4, "slow"), (5, " "), (6, "x"), (7, None)], "k int, speech string").withColumn("source", F.lit(None).cast("string"))
    got = {r.k: (len(r.findings), r.judge_error) for r in review.judge(pages, "speech", "source", service, deadline=1.0, attempts=2, wait=0.0).collect()}
    assert set(got) == {1, 2, 3, 4, 6} and got[1] == (1, None) == got[6]
    assert got[2] == (0, "OSError: HTTP 500") and got[3] == (0, "NotAnObject: the reply is of type list") and got[4] == (0, "no answer in 1 s")
    assert asked(service(), "", "x")["findings"]


def test_dots_are_asked_for_in_a_pool(spark, service):
    text = "0.3 = 0.333... {}"
    pages = spark.createDataFrame([(1, text.format("")), (2, text.format("slow")), (3, "plain")], "k int, t string")
    got = {r.k: r for r in dots.restore(pages, "k", "t", service, deadline=1.0).collect()}
    assert got[1].patched.startswith("0.3̇ =") and got[2].error == "no answer in 1 s" and got[2].patched == text.format("slow") and got[3].error is None


@pytest.fixture
def scripted(tmp_path):
    """Services that leave a file for each call; the judge suggests a case for each page, and can be down."""

    def touch(kind, what):
        open(f"{tmp_path}/{kind}-{abs(hash(what))}-{time.time_ns()}", "w").close()

    class Reader:
        def pages(self, name, content):
            touch("read", name)
            return content.decode().split("|")

    class Judge:
        def json(self, system, user, temperature=None):
            touch("judge", user)
            if (tmp_path / "down").exists():
                raise SystemError("the machine is gone")
            case = {"id": "c", "input": "same input", "must": ["x"]}
            return {"findings": [{"severity": "warn", "explanation": "why", "suggested_case": case}]}

    def calls(kind):
        return len(list(tmp_path.glob(f"{kind}-*")))

    return Reader, Judge, calls, tmp_path


def test_an_inbox_is_reviewed_once(spark, scripted):
    reader, judge, calls, at = scripted
    folder = f"file://{at}/run"
    first = spark.createDataFrame([("a b.png", "x²+1|".encode()), ("c.png", "빈 칸 $\\\\weird$".encode())], "name string, content binary")
    how = dict(ocr=reader, judge=judge, attempts=1)
    # broken off before the judge: pages and speech stay
    steps = pipelines.review_steps(**how)
    killed = [*steps[:3], ("reviewed", lambda rows: rows.withColumn("x", F.raise_error(F.lit("killed"))))]
    with pytest.raises(Exception):  # noqa: B017
        runs.work_off(spark, folder, first.withColumn("input", F.when(F.col("name") == "c.png", "c").otherwise("a_b")), "input", killed)
    assert calls("read") == 2 and calls("judge") == 0
    got = pipelines.review_inbox(spark, first, folder, **how)
    assert calls("read") == 2 and calls("judge") == 2 and got == {"inputs": 2, "errors": 3, "warnings": 2, "judge_errors": 1, "exit_code": 1}
    assert pipelines.review_inbox(spark, first, folder, **how) == {"inputs": 0, "errors": 0, "warnings": 0, "judge_errors": 0, "exit_code": 0} and calls("judge") == 2
    # another file; the case that all pages suggest is there once
    more = first.union(spark.createDataFrame([("d.png", b"fine")], "name string, content binary"))
    assert pipelines.review_inbox(spark, more, folder, **how)["inputs"] == 1 and calls("read") == 3
    assert [(r.case_input, r.batch) for r in spark.read.parquet(f"{folder}/suggested").collect()] == [("same input", 0)]
    report = "".join(r.piece for r in sorted(spark.read.parquet(f"{folder}/reports").filter("input = 'c'").collect(), key=lambda r: r.offset))
    assert report.startswith("## c_0\n- lint [error]") and "- judge [warn] other: why" in report
    # forced from speech on: recognition stays cached, the judge is down
    (at / "down").touch()
    again = pipelines.review_inbox(spark, more, folder, force="spoken", **how)
    assert calls("read") == 3 and again["inputs"] == 3 and again["judge_errors"] == 4


def test_inputs_of_few_bytes_are_dealt_over_tasks(spark, tmp_path):
    """A step's tasks follow its inputs, not their bytes, and the inputs are read once for their keys and once for the first step."""
    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(x):
        reads.add(1)
        return f"i{x}"

    inputs = spark.range(2000, numPartitions=1).select(read.asNondeterministic()("id").alias("input"))
    step = lambda rows: rows.withColumn("task", F.spark_partition_id())
    stages = runs.work_off(spark, str(tmp_path / "run"), inputs, "input", [("one", step), ("two", lambda rows: step(rows.drop("task")))])
    for s in stages.values():
        assert s.rows().count() == 2000 and s.rows().select("task").distinct().count() == 4
    assert reads.value == 4000
    assert runs.dealt(spark.range(10), "id", 60_000).rdd.getNumPartitions() == 6 and runs.dealt(spark.range(10), "id", 3).rdd.getNumPartitions() == 1
