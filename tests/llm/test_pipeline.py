"""The corpus pipeline on a small fixture against its stages chained by hand."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from quern.llm import mixing, personal_data, quality_rules, sentencepiece  # noqa: E402
from quern.llm.queries import PIECES, vocabulary_file  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(seed=2):
    """Good documents, near and exact copies of them, junk, personal data, nulls and empty texts."""
    rnd = random.Random(seed)
    prose = lambda n: " ".join(rnd.choice("abcdefghij") * rnd.randint(1, 3) + f"{rnd.choice('klmnop')}{rnd.choice('aeiou')}{rnd.choice('rst')}" for _ in range(n))
    texts = [". ".join(prose(rnd.randint(5, 12)).capitalize() for _ in range(rnd.randint(12, 25))) + ".\nEnd of it." for _ in range(40)]
    texts += [texts[0], texts[1] + " tail", texts[2].replace("End", "Stop")] + ["buy!! ### now $$$ " * 40, "short one", "The The " * 60, None, ""]
    texts += [". ".join(prose(9).capitalize() for _ in range(15)) + f" write to a{k}@b.org or call +1 415 555 01{k:02d} " + prose(50) for k in range(3)]
    return [(k, t, "en", None if k % 9 == 0 else f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]


def shingles(t, n=5):
    w = WORD.findall(t.lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def test_run_against_chained_stages(spark, tmp_path):
    rows = table()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("other") for c in ("rules", "pii_spans", "kept", "size", "near_dedup_id")})
    df.repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    text = {r[0]: r[1] or "" for r in rows}
    # quality rules: what fails the base rules goes, good documents stay
    kept = {r.doc_id for r in quality_rules.rate(df).where("kept").collect()}
    assert set(range(40)) <= kept and kept.isdisjoint(range(43, 48))
    # near-dedup by all pairs: the smallest id of each group
    ids, gone = sorted(kept), set()
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            one, two = shingles(text[a]), shingles(text[b])
            if 100 * len(one & two) >= 80 * len(one | two):
                gone.add(b)
    left = [k for k in ids if k not in gone]
    assert gone == {40, 41, 42}
    # personal data: every span that is listed for these documents becomes its kind
    spans = {r.doc_id: r.spans for r in personal_data.find(df.where(F.col("doc_id").isin(left))).collect()}
    for k in left:
        for kind, a, b in sorted((s.split(":") for s in spans[k].split(",") if s), key=lambda s: -int(s[1])):
            text[k] = text[k][: int(a)] + f"[{kind.upper()}]" + text[k][int(b) :]
    assert sum("[EMAIL]" in t and "[PHONE]" in t for t in text.values()) == 3
    # mixing: documents as often as their taken words hold them, each source near its target
    clean = spark.createDataFrame([(k, text[k], "en", rows[k][3], len(text[k])) for k in left], SCHEMA)
    plan = mixing.plan_mix(clean).collect()
    times = collections.Counter({r.doc_id: int(r.taken / r.size + 0.5) for r in plan})
    for source in {r.source for r in plan}:
        mine = [r for r in plan if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 64 * 2
        assert abs(sum(times[r.doc_id] * r.size for r in mine) - mine[0].target) <= 3 * max(r.size for r in mine)
    # token ids
    codec = sentencepiece.Codec(sentencepiece.load(vocabulary_file(PIECES)))
    want = collections.Counter({(k, tuple(np.frombuffer(codec.encode(text[k]), "<i4").tolist())): n for k, n in times.items() if n})
    got = collections.Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect())
    assert got == want


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    df = spark.createDataFrame(table(), SCHEMA).withColumn("extra", F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, "").columns == df.columns and stage(spark, df.limit(0), "").count() == 0
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", None, None, 0), (1, None, "en", "s", None), (1, "a b", "en", "s", 3)], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, "").count() >= 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "personal_data", "mixing", "sentencepiece"] and corpus_pipeline.ORACLE_SQL is None
