"""The corpus pipeline as a whole against plain Python, stage by stage, on a small corpus."""

import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import mixing
from tests.llm import brute
from tests.llm.test_operators import ODD, edited, plain_leaks, prose

INSULTS = ["vilekork", "dumbzat", "fouljink"]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r, texts = random.Random(30), prose(31, 150)
    items = [" ".join(t.split(" ")[:24]) for t in prose(32, 6)] + [None, ""]
    for k in range(0, 60, 2):
        w = texts[k].split(" ")
        for j in range(3):
            w.insert(r.randint(0, len(w)), INSULTS[j])
        texts[k] = " ".join(w)
    texts += [texts[101], texts[103], edited(texts[105], 1, 0.02), edited(texts[107], 2, 0.01)]
    texts += [f"{texts[110]} {items[0]} {texts[111]}", f"{items[3]} {texts[112]}", *ODD]
    rows = [(3 * i + 2, t, "en", ["a", "b", None, "c"][i % 4 if i % 3 else 0], len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[120], (None, texts[121], "de", "a", 1)], items


def counted(rows):
    return sorted(map(repr, rows))


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows of each stage, by name, and what the plain versions need."""
    folder = str(tmp_path_factory.mktemp("sf"))
    rows, items = corpus()
    toxic = [(i, int(any(w in t for w in INSULTS))) for i, t, *_ in rows if i is not None and t]
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in toxic], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.keep(stage(spark, docs, folder), f"test-{name}")
        out[name] = docs
    return rows, items, out, folder


def test_toxic_documents_go(stages):
    rows, _, out, _ = stages
    want = [r for r in rows if not any(w in (r[1] or "") for w in INSULTS)]
    assert counted(map(tuple, out["toxicity"].collect())) == counted(want)


def test_one_of_each_group_stays(stages):
    _, _, out, _ = stages
    before = [tuple(r) for r in out["toxicity"].collect()]
    kept = {i for i, _, _, k in brute.near_duplicates([r[:2] for r in before]) if k and i is not None}
    got = [tuple(r) for r in out["near_dedup"].collect()]
    assert len(before) - 5 <= len(got) < len(before) and set(got) <= set(before)
    assert sorted(r[0] for r in got if r[0] is not None) == sorted(kept)
    assert counted(r for r in got if r[0] is None) == counted(r for r in before if r[0] is None)


def test_leaks_go(stages):
    _, items, out, _ = stages
    before = [tuple(r) for r in out["near_dedup"].collect()]
    want = [r for r in before if not plain_leaks([t or "" for t in items], r[1])]
    assert len(want) == len(before) - 2 and counted(map(tuple, out["decontamination"].collect())) == counted(want)


def test_mixture_takes_what_the_plan_says(stages):
    _, _, out, _ = stages
    before = [tuple(r) for r in out["decontamination"].collect()]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(before, columns=[c.split(" ")[0] for c in COLUMNS.split(", ")]).astype({"doc_id": "Int64"}))
    taken = {(i, n): t for i, n, _, _, t in con.sql(mixing.ORACLE).fetchall()}
    want = []
    for i, text, *rest in before:
        w = brute.words(text)
        if w:
            full, part = divmod(taken[i, len(w)], len(w))
            want += [(i, text, *rest)] * full
            want += [(i, b" ".join(w[:part]).decode(), *rest)] * (part > 0)
    assert counted(map(tuple, out["mixture"].collect())) == counted(want)


def test_token_files_hold_the_mixture(stages):
    _, _, out, _ = stages
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [(r.doc_id, own.encode(r.text, add_special_tokens=False).ids + [2]) for r in out["mixture"].collect()]
    got = out["token_files"].collect()
    assert counted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == counted((i, len(x), zlib.crc32(np.asarray(x, "<u4").tobytes())) for i, x in ids)
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.start for r in by_start] == np.cumsum([0, *[r.n_tokens for r in by_start]])[:-1].tolist()


def test_run_applies_the_stages(spark, stages):
    *_, out, folder = stages
    assert counted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == counted(map(tuple, out["token_files"].collect()))


def test_empty_tables_and_more_columns(spark, tmp_path):
    rows, items = corpus()
    docs = spark.createDataFrame([(*r, "x", 1.5) for r in rows[100:112]], COLUMNS + ", __tsr_score string, part double")
    for name, table in (("documents", docs.limit(0)), ("benchmark", spark.createDataFrame([], "item_id long, text string")), ("labels", spark.createDataFrame([], "doc_id long, quality int, toxic int"))):
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
