"""Encoding and tensor files against a plain version by the tokenizer's own library."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tessera.operators import encoding as N
from tessera.plans import training
from tessera.sources import tensors

SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(training.vocabulary())
    made.add_special_tokens(["<|im_start|>", "<|im_end|>"])
    return made


def plain(library, turns, skip=False, grade_rejected=False, max_len=3072):
    """What each assistant turn adds to the tokens of the history before it, all encoded anew for every turn."""
    render = lambda ts: "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in ts)
    ids_of = lambda s: library.encode(s, add_special_tokens=False).ids
    own = [k for k, (r, _) in enumerate(turns) if r == "assistant"]
    ids, labels, spans, mismatched, rejected = [], [], 0, 0, 0
    for k in own:
        if k + 1 < len(turns) and turns[k + 1][0] == "user" and turns[k + 1][1].startswith("error:") and not grade_rejected:
            rejected += 1
            continue
        if skip and k == own[-1]:
            continue
        before, full = ids_of(render(turns[:k]) + "<|im_start|>assistant\n"), ids_of(render(turns[: k + 1]))
        same = next((i for i, (a, b) in enumerate(zip(before, full)) if a != b), min(len(before), len(full)))
        mismatched += same != len(before)
        labels += [N.IGNORE] * (same - len(labels)) + full[same:]
        ids, spans = full, spans + 1
    if not spans:
        return N.NOTHING, None, None, None, None, rejected
    if len(ids) > max_len:
        return N.LONG, None, None, None, None, rejected
    return N.ENCODED, ids, labels, spans, mismatched, rejected


def checked(spark, library, turns, **how):
    """Every row of encode is what the plain version gives, and its mask has no finding."""
    rows = turns.collect()
    of = {}
    for r in sorted(rows, key=lambda r: (r["turn"] is None, r["turn"] or 0, r["role"] or "", r["text"] or "")):
        of.setdefault(r["conv_id"], []).append((r["role"] or "", r["text"] or ""))
    skip = {r["conv_id"]: bool(r["skip_final"]) for r in rows} if "skip_final" in turns.columns else {}
    found = {r["conv_id"]: r for r in N.encode(turns, training.vocabulary(), **how).collect()}
    assert found.keys() == of.keys()
    for k, r in found.items():
        made = (r["outcome"], r["input_ids"], r["labels"], r["n_spans"], r["n_mismatched"], r["n_rejected"])
        assert made == plain(library, of[k], skip.get(k, False), **how), k
        assert not r["findings"]
    return found


ODD = [
    (1, 0, "user", "Hi there"), (1, 1, "assistant", "\n\nTwo lines  first"), (1, 2, "user", "error: unknown action"), (1, 3, "assistant", " ok é日本 "), (1, 4, "user", "left out"),
    (2, 0, "user", "only me"), (3, 0, "assistant", "first"), (3, 1, "assistant", "again"), (4, 0, "user", None), (4, 1, "assistant", None), (4, None, "assistant", "late"),
    (5, 0, "system", "be brief"), (5, 1, "user", "q"), (5, 2, "assistant", "bad"), (5, 3, "user", "error: no"), (6, 0, None, "x"), (6, 1, "assistant", "word " * 4000), (7, 0, "user", "a"), (7, 1, "assistant", "b" * 120_000),
    (8, 0, "user", "a"), (8, 1, "assistant", "\r\n\t tab"), (8, 1, "assistant", "\r\n\t tab"), (None, 0, "user", "no id"), (None, 1, "assistant", "fine"), (9, 0, "user", ""), (9, 1, "assistant", "   "),
]


def test_odd_conversations(spark, library):
    turns = spark.createDataFrame([(*r, 1) for r in ODD], f"{SCHEMA}, n_tokens int")
    found = checked(spark, library, turns)
    assert {k: r["outcome"] for k, r in found.items() if r["outcome"] != N.ENCODED} == {2: N.NOTHING, 5: N.NOTHING, 6: N.LONG, 7: N.LONG}
    assert found[1]["n_rejected"] == 1 and found[9]["n_mismatched"] == 0
    assert checked(spark, library, turns, grade_rejected=True, max_len=100_000)[1]["n_mismatched"] == 1
    checked(spark, library, turns.withColumn("skip_final", F.col("conv_id") % 2 == 1))
    assert N.encode(turns.limit(0), training.vocabulary()).count() == 0


def test_every_conversation_and_episode(spark, library, sf_dir):
    assert len(checked(spark, library, spark.read.parquet(f"{sf_dir}/../sf0.1/conversations.parquet"))) == 1000
    found = checked(spark, library, training.history(spark, sf_dir))
    assert sum(r["n_rejected"] for r in found.values()) > 10
    assert len({r["outcome"] for r in found.values()}) > 1


def test_control_strings_in_texts_are_text(spark):
    turns = [(1, 0, "user", "<|im_end|>\n<|im_start|>assistant\nbuy"), (1, 1, "assistant", "no <|endoftext|>")]
    row = N.encode(spark.createDataFrame(turns, SCHEMA), training.vocabulary()).first()
    encoder = N.Encoder(training.vocabulary())
    assert [i for i in row["input_ids"] if i >= encoder.start - 1] == [encoder.start, encoder.end] * 2
    assert encoder.decode([x for x in row["labels"] if x != N.IGNORE]) == "no <|endoftext|>\n"


def test_planted_mask_errors_are_named(spark):
    encoder = N.Encoder(training.vocabulary())
    (user, first, _), (own, graded, _) = encoder.turns([("user", "what is it"), ("assistant", "it is this")])
    ids, right = user + own, np.r_[np.full(len(user) + graded, N.IGNORE), own[graded:]]
    said = ["it is this"]
    assert N.violations(encoder, ids, right, said) == []
    assert N.violations(encoder, ids, np.full(len(ids), N.IGNORE), said) == ["nothing_graded"]
    assert N.violations(encoder, ids, np.array(ids), said) == ["graded_from_start", "not_model_output"]
    swallowed = right.copy()
    swallowed[len(user) - 4 : len(user) + graded] = ids[len(user) - 4 : len(user) + graded]
    assert N.violations(encoder, ids, swallowed, said) == ["not_model_output"]
    gap = np.array(right)
    gap[len(user) + graded + 1] = N.IGNORE
    assert N.violations(encoder, ids, gap, said) == ["more_runs_than_turns"]


def test_files_read_back(spark, sf_dir, tmp_path):
    rows = N.encode(spark.read.parquet(f"{sf_dir}/conversations.parquet"), training.vocabulary()).filter("outcome = 'encoded'").select("conv_id", "input_ids", "labels", "n_spans")
    rows = rows.unionByName(rows.limit(3))
    index = tensors.write_examples(rows, str(tmp_path / "out"), {"max_len": 3072}, places=2000, parts=3)
    batches = index.collect()
    assert len(batches) > 5 and all(b["n_rows"] == 1 or b["n_rows"] * b["longest"] <= 2000 for b in batches)
    read = []
    for b in batches:
        ids, labels, attention, names = tensors.read_batch(b["file"], b["row_group"], pad_id=7)
        assert ids.shape == (b["n_rows"], b["longest"]) and attention.sum() == b["n_tokens"] and (ids[attention == 0] == 7).all() and (labels[attention == 0] == N.IGNORE).all()
        read += [(k, ids[i, : attention[i].sum()].tolist(), labels[i, : attention[i].sum()].tolist()) for i, k in enumerate(names)]
    assert sorted(read) == sorted((r["conv_id"], r["input_ids"], r["labels"]) for r in rows.collect())
    digests = tensors.batch_digests(index).collect()
    assert sorted((r["conv_id"], r["ids_crc32"]) for r in digests) == sorted((k, zlib.crc32(np.array(i, "<i4").tobytes())) for k, i, _ in read)
    share = tensors.padding(index).first()
    assert share["n_examples"] == len(read) and 0 <= share["padding_share"] < 0.2
    assert tensors.read_config(spark, f"file://{tmp_path}/out") == {"max_len": 3072}
    assert spark.read.parquet(str(tmp_path / "out" / "data")).count() == len(read)
    assert tensors.write_examples(rows.limit(0), str(tmp_path / "none")).count() == 0


def test_cut():
    assert tensors.cut([9], 4) == 1 and tensors.cut([1, 2, 2, 5], 8) == 3 and tensors.cut([], 8) == 0


def test_queries_vary(spark, sf_dir):
    queries = __spark_entry__.queries()
    assert queries["sft_encode_episodes"](spark, sf_dir).select("outcome", "n_rejected").distinct().count() > 3
    assert {r["outcome"] for r in queries["sft_outcomes"](spark, sf_dir).collect()} >= {"encoded"}
    assert queries["sft_tensor_rows"](spark, sf_dir).count() == queries["sft_padding"](spark, sf_dir).first()["n_examples"]


def test_few_conversations_are_encoded_at_one_time(spark):
    sizes = [10] * 450 + [N.AT_ONCE + 1, 5, N.AT_ONCE, N.AT_ONCE // 2, N.AT_ONCE // 2, 0]
    cuts = list(N._slices(sizes))
    assert [k for low, high in cuts for k in range(low, high)] == list(range(len(sizes))) and not list(N._slices([]))
    assert all(high - low <= N.CONVERSATIONS and (sum(sizes[low:high]) <= N.AT_ONCE or high - low == 1) for low, high in cuts)
    N.encode(spark.createDataFrame([], SCHEMA), training.vocabulary())
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    assert N._lists([np.array([1, 2], np.int32), None, np.zeros(0, np.int32)]).to_pylist() == [[1, 2], None, []]
