"""Question sets and checkpoint folders as data sources, on files on disk."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In

from tessera.sources import tasksets as T

PAIRED = [
    {"id": "a", "question": "q1", "answer": "x", "context": {"title": ["T", 1999], "sentences": [["One.", " Two."], ["Year."]]}, "supporting_facts": {"title": ["T", 1999, "T"], "sent_id": [0, 0, 1]}},
    {"id": "b", "question": "q2", "answer": "y", "context": None, "supporting_facts": None},
]
PAIRS = [{"id": "c", "question": "q", "answer": "z", "context": [["A", ["s1", "s2"]], [7, []]], "supporting_facts": [["A", 0], [7, 1], ["A", 2]]}]
HOPS = [
    {"id": "3hop1__x", "question": "q", "answer": "ans", "answer_aliases": ["ans", "al"], "paragraphs": [{"title": " D ", "paragraph_text": "p", "is_supporting": False}, {"title": "D", "paragraph_text": "r", "is_supporting": True}]},
    {"id": "2hop__y", "question": "é日", "answer": "n", "answer_aliases": None, "paragraphs": []},
    {"id": "odd", "question": "q", "answer": "n", "paragraphs": None},
]


@pytest.fixture
def read(spark, tmp_path):
    T.register(spark)

    def of(rows, shape, parts=1, **options):
        folder = tmp_path / f"{shape}-{parts}"
        folder.mkdir(exist_ok=True)
        for k in range(parts):
            (folder / f"part-{k}.jsonl").write_text("\n".join([*(json.dumps(r, ensure_ascii=False) for r in rows[k::parts]), ""]), encoding="utf-8")
        (folder / "notes.md").write_text("no rows")
        (folder / "_draft.jsonl").write_text("no rows")
        reader = spark.read.format("tessera_tasks").option("path", str(folder)).option("shape", shape)
        for k, v in options.items():
            reader = reader.option(k, v)
        return reader.load()

    return of


def test_shapes(read):
    paired = {r["task_id"]: r for r in read(PAIRED, "paired_lists", dataset="hotpot").collect()}
    assert paired["hotpot-a"]["supporting_titles"] == ["T", "1999"] and [tuple(p) for p in paired["hotpot-a"]["passages"]] == [("T", "One.  Two."), ("1999", "Year.")]
    assert paired["hotpot-b"]["passages"] == [] and paired["hotpot-b"]["n_hops"] is None
    pair = read(PAIRS, "pair_context").first()
    assert pair["task_id"] == "pair_context-c" and pair["supporting_titles"] == ["A", "7"] and [tuple(p) for p in pair["passages"]] == [("A", "s1 s2"), ("7", "")]
    hops = {r["task_id"]: r for r in read(HOPS, "hop_paragraphs", 2).collect()}
    assert [tuple(p) for p in hops["3hop1__x"]["passages"]] == [("D", "p"), ("D (2)", "r")] and hops["3hop1__x"]["supporting_titles"] == ["D (2)"]
    assert hops["3hop1__x"]["gold_aliases"] == ["al"] and (hops["3hop1__x"]["hops"], hops["3hop1__x"]["n_hops"]) == ("3hop1", 3)
    assert hops["2hop__y"]["question"] == "é日" and hops["odd"]["n_hops"] == 0


@pytest.mark.parametrize("stretch", [1, 37, 100, 10_000])
def test_stretches_read_every_line_once(read, stretch):
    rows = [{"id": f"2hop__{i}", "question": "ü" * (i % 9), "answer": "n", "paragraphs": []} for i in range(60)]
    df = read(rows, "hop_paragraphs", 3, stretch=stretch)
    assert sorted(r["task_id"] for r in df.collect()) == sorted(r["id"] for r in rows)


def test_filters_reach_the_reader(read):
    df = read(HOPS, "hop_paragraphs")
    few = df.filter((F.col("n_hops") >= 2) & F.col("task_id").isin("3hop1__x", "odd"))
    assert [r["task_id"] for r in few.collect()] == ["3hop1__x"]
    assert df.filter("question = 'é日'").count() == 1 and df.filter("task_id = 'none'").count() == 0
    reader = T.TaskReader({"path": "x", "shape": "hop_paragraphs"})
    left = [EqualTo(("question",), "q")]
    assert list(reader.pushFilters([In(("task_id",), ("a", "b")), GreaterThanOrEqual(("n_hops",), 2), *left, EqualTo(("task_id",), "b"), GreaterThanOrEqual(("n_hops",), 3)])) == left
    assert reader.ids == {"b"} and reader.least_hops == 3


def test_no_files_and_unknown_shape(spark, read, tmp_path):
    assert read([], "pair_context").count() == 0
    with pytest.raises(Exception, match="shape must be one of"):
        spark.read.format("tessera_tasks").option("path", str(tmp_path)).option("shape", "other").load().count()


def test_checkpoints(spark, tmp_path):
    T.register(spark)
    folder, out = tmp_path / "run", f"file://{tmp_path}/out"
    load = lambda r: r.format("tessera_checkpoints").option("path", str(folder)).load()
    assert load(spark.read).count() == 0
    for name in ("global_step_5/actor", "global_step_20/actor", "global_step_7/critic", "global_step_x/actor", "other"):
        (folder / name).mkdir(parents=True)
    assert [r["step"] for r in load(spark.read).collect()] == [5, 20]
    seen = []
    put = lambda batch, k: seen.append(sorted(r["step"] for r in batch.collect()))
    q = load(spark.readStream).writeStream.foreachBatch(put).option("checkpointLocation", f"{out}/q").start()
    try:
        q.processAllAvailable()
        (folder / "global_step_25/actor").mkdir(parents=True)
        import time

        deadline = time.time() + 30
        while [25] not in seen and time.time() < deadline:
            time.sleep(0.5)
    finally:
        q.stop()
    assert [s for s in seen if s] == [[5, 20], [25]]


