from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from lexidrift.functions import constants as K
from lexidrift.functions import text as T
from lexidrift.operators import patterns as P


def one(spark, column, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("t"))).collect()]


def test_paragraphs_and_white_space(spark):
    got = one(spark, T.paragraphs, "A  one.\n \n\nB\x1ctwo.", "", None, " \n\n ", "a\nb")
    assert got == [["A one.", "B two."], [], [], [], ["a b"]]


def test_sentences_drop_closing_quotes_at_a_boundary(spark):
    got = one(spark, T.sentences, 'He said "Hi." Then left.', "One. two. Three! 4 left? (Yes.)", "Don't. ’Tis", "")
    assert got[0] == ['He said "Hi.', "Then left."]
    assert got[1] == ["One. two.", "Three!", "4 left?", "(Yes.)"]
    assert got[3] == []


def test_tokens_stay_ascii_and_keep_numbers(spark):
    got = one(spark, T.tokens, "It’s 1,000.5 cafés, ISN'T ٣ it?", "", None)
    assert got[0] == ["it's", "1,000.5", "caf", "s", "isn't", "٣", "it"]
    assert got[1] == [] and got[2] is None


def test_ngrams_never_cross_sentences_and_need_a_lexical_word(spark):
    docs = spark.createDataFrame([(1, "Grey herons wade. Otters swim past."), (2, "It was of the 1 2."), (3, None), (4, "")], "doc_id int, text string")
    got = {(r.doc_id, r.pattern): r.n for r in P.ngram_rows(docs, ["doc_id"]).collect()}
    assert (1, "grey herons wade") in got and not any("wade otters" in p for _, p in got)
    assert (2, "1 2") not in got and (2, "it was") not in got
    assert (2, "the 1") in got and {d for d, _ in got} == {1, 2}


def test_windows_guard_short_lists(spark):
    rows = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "x array<string>")
    assert [r[0] for r in rows.select(T.windows(F.col("x"), 2)).collect()] == [[["a", "b"], ["b", "c"]], [], []]
    assert [r[0] for r in rows.select(T.windows(F.col("x"), 0)).collect()] == [[], [], []]


def brute_skeleton(text):
    import unicodedata

    text = unicodedata.normalize("NFKC", text).replace("’", "'").replace("‘", "'").lower()
    out = []
    for t in re.findall(r"[A-Za-z]+(?:'[A-Za-z]+)?|\d+(?:[.,]\d+)*|[.!?,;:]", text):
        for u in K.CONTRACTIONS.get(t, (t,)):
            v = u if u in K.PUNCTUATION or u in K.ANCHORS else K.NUMBER_SLOT if u[0].isdigit() else K.SLOT
            if not (out and v == out[-1] and v in (K.SLOT, K.NUMBER_SLOT)):
                out.append(v)
    return out


def brute_spans(tokens, boundary=None):
    out = []
    for i in range(len(tokens)):
        for j in range(i + 3, min(len(tokens), i + 12) + 1):
            s = tokens[i:j]
            if (boundary is None or i < boundary < j) and 1 <= sum(t in (K.SLOT, K.NUMBER_SLOT) for t in s) <= 3 and sum(t in K.ANCHORS for t in s) >= 2:
                out.append(" ".join(s))
    return out


SKELETONS = [
    ("The old wooden gate is not locked.", "the <X> is not <X> ."),
    ("They had 7 of the 9.", "they had <NUM> of the <NUM> ."),
    ("She isn't late.", "she is not <X> ."),
    ("They can't wait…", "they can not <X> . . ."),
    ("", ""),
]


def test_skeletons(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SKELETONS)], "i int, t string").select("i", T.nfkc(F.col("t")).alias("t"))
    got = [r[1] for r in rows.select("i", F.array_join(T.skeleton(F.col("t")), " ")).orderBy("i").collect()]
    assert got == [s for _, s in SKELETONS]
    assert [" ".join(brute_skeleton(t)) for t, _ in SKELETONS] == got


def test_anchor_list():
    assert len(K.ANCHORS) == len(set(K.ANCHORS)) == 117
    assert set(K.CONTRACTIONS) <= set(K.ANCHORS)


SENTENCES = ["It was not a storm but a shower.", "That isn't about money.", "It's about trust.", "He is who he is.", "Green lamps hum softly.", "It was 2 of the 3, and they don't know which of them.", "", "He said: who is it that they want, not the one in the house over there?"]


def test_skeleton_counts_equal_brute_force(spark):
    docs = [(i, " ".join(SENTENCES[i : i + 3]) + "\n\n" + SENTENCES[(i + 5) % 8]) for i in range(8)] + [(99, None)]
    frame = spark.createDataFrame(docs, "doc_id int, text string")
    got = {(r.doc_id, r.kind, r.pattern): r.n for r in P.skeleton_counts(frame, ["doc_id"]).collect()}
    sents = {}
    for r in P.sentence_rows(frame, ["doc_id"]).orderBy("doc_id", "para_idx", "sent_idx").collect():
        sents.setdefault((r.doc_id, r.para_idx), []).append(r.sentence)
    want = {}
    for (d, _), ss in sents.items():
        sk = [brute_skeleton(s) for s in ss]
        for s in sk:
            for p in brute_spans(s):
                want[d, K.WITHIN, p] = want.get((d, K.WITHIN, p), 0) + 1
        for a, b in zip(sk, sk[1:]):
            for p in brute_spans(a + b, len(a)):
                want[d, K.CROSS, p] = want.get((d, K.CROSS, p), 0) + 1
    assert got == want
    assert (0, K.WITHIN, "not a <X> but a <X>") in got
    assert any(k == K.CROSS and p == "about <X> . it's about" for _, k, p in got)


FRAMES = [
    ("The point is not price, but where it was made.", {"contrast_not_but": 1}),
    ("The trouble isn't whether trains run late. It's who waits for them.", {"reframe_isnt_its": 1}),
    ("The trouble isn’t noise, it’s the cold.", {"reframe_isnt_its": 1}),
    ("The trouble isn't noise, it's the cold.", {"reframe_isnt_its": 1}),
    ("The trouble isn't whether trains run late. The rain is worse. It's who waits for them.", {}),
    ("The point is not price, but where it was made. Wool is dearer.", {"contrast_not_but": 1}),
    ("The trouble isn't whether trains run late.\n\nIt's who waits for them.", {}),
    ("They wondered whether the boat was dry or not.", {}),
    ("It is not only warm but also dry.", {"contrast_not_but": 1, "not_only_but_also": 1}),
    ("That isn't about money. It's about trust.", {"reframe_about": 1, "reframe_isnt_its": 1}),
    (None, {}),
]


def test_frames(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(FRAMES)], "doc_id int, text string")
    got = {}
    for r in P.frame_rows(docs, ["doc_id"]).collect():
        got.setdefault(r.doc_id, {})[r.kind] = r.n
    assert [got.get(i, {}) for i in range(len(FRAMES))] == [w for _, w in FRAMES]
    assert not {k for k, _, _ in K.FRAMES} & set(K.WITHDRAWN_FRAMES)


def test_exposure_counts_empty_documents(spark):
    docs = spark.createDataFrame([("c", "Rain fell. Snow fell.\n\nIce broke. Ice froze. Ice melted."), ("c", ""), ("c", None), ("d", "Cats nap. Dogs nap. Mice nap.")], "corpus string, text string")
    got = {r.corpus: r for r in P.exposure(docs, ["corpus"]).collect()}
    assert (got["c"].documents, got["c"].paragraphs, got["c"].sentences, got["c"].adjacent_pairs) == (3, 2, 5, 3)
    assert (got["d"].documents, got["d"].sentences, got["d"].adjacent_pairs) == (1, 3, 2)


def test_rates_by_family(spark):
    docs = spark.createDataFrame([("c", 1, "It was not a storm but a shower. It's over.")], "corpus string, doc_id int, text string")
    got = {(r.kind, r.pattern): r for r in P.structural_rates(docs, ["corpus"], "doc_id").collect()}
    row = got[K.WITHIN, "not a <X> but a <X>"]
    assert row.per_10k == pytest.approx(row.occurrences / 2 * 10_000) and row.combined_per_10k == pytest.approx(row.occurrences / 3 * 10_000)


def test_streaming_rows_equal_batch_rows(spark):
    from lexidrift.streaming.counts import document_ngrams

    docs = spark.createDataFrame([(1, "Red ball here. Red ball there."), (2, ""), (3, None)], "doc_id int, text string")
    a = {(r.doc_id, r.pattern, r.n) for r in document_ngrams(docs).collect()}
    b = {(r.doc_id, r.pattern, r.n) for r in P.ngram_rows(docs, ["doc_id"]).collect()}
    assert a == b and (1, "red ball", 2) in a


def test_stream_of_documents(spark, tmp_path):
    from lexidrift.streaming.counts import windowed_counts

    rows = spark.sql("select timestamp'2024-01-01 10:00:00' as doc_ts, 'Red ball here. Red ball there.' as text union all select timestamp'2024-02-01 10:00:00', 'Blue ball.'")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    query.processAllAvailable()
    query.stop()
    got = {(r.pattern, r.occurrences, r.documents_with) for r in spark.sql("select * from counts").collect()}
    assert ("red ball", 2, 1) in got and ("blue ball", 1, 1) in got
