"""The pipeline on odd rows: what each stage keeps, against plain rules."""

import random
from collections import Counter

import corpus_pipeline as P
from reelrank.llm import queries as Q

DOC = "doc_id long, text string, lang string, source string, n_chars long"
VOWELS, REST = "aeiou", "bcdfghklmnprstw"


def _documents():
    rng = random.Random(12)
    word = lambda: "".join(rng.choice(REST) + rng.choice(VOWELS) for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, text(rng.randint(30, 60)), "en", rng.choice(["web", "books", None])) for i in range(40)]
    copies = [(100 + i, rows[i][1], "en", "web") for i in range(5)]  # exact copies of a whole document
    odd = [(200, None, "en", "web"), (201, "", None, "web"), (202, "12 34 -- 56", None, None), (203, "漢字" * 50, None, "web")]
    return rows, copies, odd


def test_run_on_odd_rows(spark, tmp_dir):
    rows, copies, odd = _documents()
    every = [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows + copies + odd]
    spark.createDataFrame(every, DOC).write.parquet(f"{tmp_dir}/documents.parquet")
    out = P.run(spark, tmp_dir).collect()
    kept = {r.doc_id for r in out}
    # a copy and its original: line dedup leaves one of them, the odd documents have no known language
    assert kept <= {r[0] for r in rows + copies} and not kept & {r[0] for r in odd}
    for c in copies:
        assert len(kept & {c[0], c[0] - 100}) <= 1
    per_seq, tokens = Counter(), Counter()
    for r in out:
        assert r.length > 0 and len(r.ids) == 4 * r.length
        per_seq[r.sequence_id] += r.length
        tokens[r.doc_id] += r.length
    assert sorted(per_seq) == list(range(len(per_seq))) and all(n == 2048 for s, n in per_seq.items() if s < len(per_seq) - 1)
    # whole repetitions, two at the most
    size = {r.doc_id: r.doc_tokens for r in out}
    assert all(tokens[i] % size[i] == 0 and tokens[i] // size[i] in (1, 2) for i in kept)


def test_stages_keep_the_columns(spark, tmp_dir):
    rows, copies, odd = _documents()
    docs = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows + copies + odd + rows[:2]], DOC)
    docs = P.language_id(spark, docs, tmp_dir)
    left = Counter(r.doc_id for r in docs.collect())
    assert left == Counter(r[0] for r in rows + copies + rows[:2])  # repeated rows are judged one by one
    for name, stage in P.STAGES[2:4]:
        got = stage(spark, docs, tmp_dir)
        assert sorted(got.columns) == sorted(docs.columns), name
        docs = got
    # one row of every text stays after SimHash, mixing may repeat it once
    texts = Counter(r.text for r in docs.collect())
    assert set(texts) <= {r[1] for r in rows} and max(texts.values()) <= 2


def test_empty_table(spark, tmp_dir):
    spark.createDataFrame([], DOC).write.parquet(f"{tmp_dir}/documents.parquet")
    assert P.run(spark, tmp_dir).collect() == []


#: Queries that SQL can't express, and the tests that hold them against plain versions.
PLAIN = {"op1_pack_documents": "test_free", "op4_language_id": "test_free", "op7_line_dedup": "test_native", "op9_simhash_neardup": "test_free",
         "op10_toxicity": "test_free", "op12_whitening": "test_whitening"}


def test_every_query_has_sql_or_a_plain_test():
    assert set(Q.queries()) - set(Q.oracle_sql()) == set(PLAIN)
