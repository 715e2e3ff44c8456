"""The pipeline's near-copy stage against all pairs."""

import random

import pytest

import corpus_pipeline
from spanwise.llm import near
from spanwise.llm.text import ensure_checkpoint_dir


def shingles(text):
    words = (text or "").lower().split()
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def first_of_near(texts, ids):
    """Places of the texts that stay, by comparing each with all that stay before it."""
    kept, sets = [], [shingles(t) for t in texts]
    for i in sorted(range(len(texts)), key=lambda i: ids[i]):
        if not any(sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9 for j in kept):
            kept.append(i)
    return sorted(kept)


@pytest.mark.parametrize("few", [0, near.FEW_ROWS])
def test_near_stage_drops_every_copy_at_0_8(spark, monkeypatch, few):
    monkeypatch.setattr(near, "FEW_ROWS", few)
    ensure_checkpoint_dir(spark)
    rnd = random.Random(80)
    texts = ["", None, " ", "one two", "One  two", "one two three"]
    for _ in range(12):
        base = [f"w{rnd.randint(0, 4000)}" for _ in range(rnd.choice([12, 80, 300]))]
        texts.append(" ".join(base))
        for edits in (0, 1, 2, 3, 5, 8):
            words = list(base)
            for _ in range(edits):
                words[rnd.randrange(len(words))] = f"edit{rnd.randint(0, 4000)}"
            texts.append(" ".join(words))
    base = [f"v{i}" for i in range(200)]  # a chain, each near the next
    for i in range(0, 200, 20):
        base[i] = f"x{i}"
        texts.append(" ".join(base))
    rnd.shuffle(texts)
    ids = list(range(len(texts)))
    docs = spark.createDataFrame([(i, t, "en") for i, t in zip(ids, texts)] + [(None, texts[0], "en")], "doc_id long, text string, lang string")
    kept = corpus_pipeline.near_stage(spark, docs, "")
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sum(r["doc_id"] is None for r in rows) == 1
    assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == first_of_near(texts, ids)
    assert corpus_pipeline.near_stage(spark, docs.limit(0), "").count() == 0
    assert near.keep_first_of_near(spark.createDataFrame([(7, "a b"), (7, "c d"), (3, "A B")], "doc_id long, text string")).count() == 2


def test_texts_that_share_keys_without_being_alike_need_few_rounds(spark, monkeypatch):
    """What the rounds leave is settled part by part; a part beyond the bounds in steps of their size."""
    monkeypatch.setattr(near, "FEW_ROWS", 300)
    ensure_checkpoint_dir(spark)
    rounds, steps, pairs, settled = [], [], near._alike, near._side_by_side
    monkeypatch.setattr(near, "_alike", lambda *a: rounds.append(1) or pairs(*a))
    monkeypatch.setattr(near, "_side_by_side", lambda *a: steps.append(1) or settled(*a))
    rnd = random.Random(81)
    texts = []
    for _ in range(2):
        base = [f"w{rnd.randint(0, 4000)}" for _ in range(120)]
        for i in range(40):  # half of the shingles are the page's own
            words = [*base, *(f"own{rnd.randint(0, 4000)}" for _ in range(38))]
            texts += [" ".join(words), " ".join([*words, "end"])] if i % 4 == 0 else [" ".join(words)]
    ids = list(range(len(texts)))
    rnd.shuffle(texts)
    kept = corpus_pipeline.near_stage(spark, spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string"), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == first_of_near(texts, ids) and len(first_of_near(texts, ids)) == 80
    assert len(rounds) == near.ROUNDS and 1 < len(steps) < 12
