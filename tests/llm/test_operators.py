from __future__ import annotations

import random
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexidrift.llm import defects as D
from lexidrift.llm import encoding, language, leakage, mixing, overlap, pairs, repetition, sampling, screen, sentences, splits, truncation

LONG = "The {} keeper counted {} lamps beside the {} harbour while nobody watched the {} road at dawn. "


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(n))


# ---- 1


def uid(n):
    return f"{n:08x}-0000-0000-0000-{n:012x}"


def test_related_sources(spark):
    a, b, c = uid(1), uid(2), uid(3)
    rows = [("r1", a), ("r2", "{" + a.upper() + "}"), (a, b), (uid(9), c), ("r3", "unknown"), ("r4", None), ("r5", ""), ("r6", "n/a"), ("r1", a), (None, c)]
    frame = spark.createDataFrame(rows, "id string, source_id string")
    got = {(r[0], r[1]) for r in splits.related_sources(frame).collect()}
    values = [a, b, "{" + a.upper() + "}"]
    assert got == {(x, y) for x in values for y in values if x < y}
    assert splits.related_sources(frame.where("false")).count() == 0


def test_a_record_under_two_sources_ties_them(spark):
    a, b, c = uid(1), uid(2), uid(3)
    frame = spark.createDataFrame([("r1", a), ("r1", b), ("r2", a), ("r3", b), ("r3", None), ("r4", c), (None, a), (None, c)], "id string, source_id string")
    assert [(r[0], r[1]) for r in splits.related_sources(frame).collect()] == [(a, b)]
    family = {r.id: r.family for r in splits.record_families(frame).collect()}
    assert family["r1"] == family["r2"] == family["r3"] != family["r4"]
    assert len({r.split for r in splits.split_records(frame).collect() if r.id != "r4"}) == 1


def test_subset_sum_at_any_number_of_records():
    """Many families: the closest total is met exactly though the sums exceed what the bits reach."""
    rng = random.Random(21)
    for _ in range(10):
        sizes = {s: rng.randint(1, 10**7) for s in rng.sample(range(2, 90), 6)} | {300: 3}
        target = rng.randint(0, sum(s * n for s, n in sizes.items()))
        got = splits.choose_counts(sizes, target)
        assert all(0 < n <= sizes[s] for s, n in got.items())
        step = np.gcd.reduce(list(sizes))
        assert abs(sum(s * n for s, n in got.items()) - target) <= step // 2


def test_components_equal_brute_force(spark):
    rng = random.Random(4)
    edges = [(f"n{rng.randint(0, 90):02d}", f"n{rng.randint(0, 90):02d}") for _ in range(70)] + [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(40)]
    edges = [(x, y) for x, y in edges if x != y]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in edges:
        x, y = sorted((find(x), find(y)))
        parent[y] = x
    got = {r.node: r.root for r in splits.connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {x: find(x) for x in parent}


@pytest.mark.parametrize("span", [1 << 21, 64])
def test_subset_sum_comes_closest(span):
    rng = random.Random(1)
    for _ in range(30):
        sizes = {rng.randint(1, 40): rng.randint(1, 4) for _ in range(5)}
        target = rng.randint(0, sum(s * n for s, n in sizes.items()))
        sums = {0}
        for s, n in sizes.items():
            sums = {x + k * s for x in sums for k in range(n + 1)}
        got = splits.choose_counts(sizes, target, span)
        assert all(0 < n <= sizes[s] for s, n in got.items())
        gap = abs(sum(s * n for s, n in got.items()) - target)
        best = min(abs(x - target) for x in sums)
        assert gap == best if span > 64 else gap <= best + 40


def test_splits_keep_families_and_shares(spark):
    rows = [(f"r{i}", uid(i // 3)) for i in range(300)] + [(f"s{i}", uid(1)) for i in range(150)]
    got = splits.split_records(spark.createDataFrame(rows, "id string, source_id string")).toPandas()
    assert got.groupby("family").split.nunique().max() == 1 and len(got) == 450
    share = got.split.value_counts(normalize=True)
    assert abs(share["test"] - 0.1) < 0.01 and abs(share["validation"] - 0.1) < 0.01
    with pytest.raises(ValueError):
        splits.assign_splits(spark.createDataFrame([("a", "f")], "id string, family string"), (("train", 0.5),))


# ---- 2


def brute_repeats(text, n):
    letters = [c for c in text.lower() if c.isalnum()]
    s = "".join(letters)
    covered = set()
    for i in range(len(s) - n + 1):
        if s.find(s[i : i + n]) < i:
            covered.update(range(i, i + n))
    return len(s), len(covered)


def test_repetition_equals_brute_force(spark):
    rng = random.Random(7)
    texts = [words(rng, 30) for _ in range(6)]
    texts += [t[:60] + "! " + t + " " + t[20:90].upper() for t in texts[:3]] + ["ab" * 60, "a" * 31, "a" * 30, "", None, " . ", "Ж" * 45 + "ж", "好" * 80]
    frame = spark.createDataFrame([(str(i), t, 1) for i, t in enumerate(texts)], "id string, generation string, letters int")
    got = {r.id: r for r in repetition.repetition_scores(frame.select("id", "generation"), lengths=(10, 30)).collect()}
    for i, t in enumerate(texts):
        for n in (10, 30):
            size, covered = brute_repeats(t or "", n)
            assert got[str(i)].letters == size and got[str(i)][f"repeated_{n}"] == covered, (i, n)
    found = {r.id for r in repetition.repetitive_ids(frame).collect()}
    assert found == {str(i) for i, t in enumerate(texts) if brute_repeats(t or "", 30)[1] >= 0.3 * brute_repeats(t or "", 30)[0] > 0}


def test_repeated_lines():
    assert repetition._line_repeats("a b\nA, B!\nc") == 2


# ---- 3

SENTENCES = [
    ("Dr. Fern met Mr. Held at 9 p.m. He paid 3.50 dollars, i.e. the rest. Ok?! Yes.", ["Dr. Fern met Mr. Held at 9 p.m.", "He paid 3.50 dollars, i.e. the rest.", "Ok?!", "Yes."]),
    ("Notes on tea\n\nSee a.v2.txt at x.example for it. J. K. Lee ordered No. 79\nof them, etc. The rest", ["Notes on tea", "See a.v2.txt at x.example for it.", "J. K. Lee ordered No. 79\nof them, etc.", "The rest"]),
    ("“Is it damp?” asked Lee. She called it “a find.” (It was.) In the U.K. trials it won.", ["“Is it damp?” asked Lee.", "She called it “a find.”", "(It was.)", "In the U.K. trials it won."]),
    ("It kept on... and then on. Wait... They left.", ["It kept on... and then on.", "Wait...", "They left."]),
    ("Am 3. Mai kam Dr. Held um 7.30 Uhr an. „Ist es offen?“, fragte Held. Das Amt zahlte z. B. 12 Euro, d. h. 2,5 mehr.", ["Am 3. Mai kam Dr. Held um 7.30 Uhr an.", "„Ist es offen?“, fragte Held.", "Das Amt zahlte z. B. 12 Euro, d. h. 2,5 mehr."]),
    ("— Где ключ? — спросил Held. В 300 г. до н. э. здесь был порт.", ["— Где ключ? — спросил Held.", "В 300 г. до н. э. здесь был порт."]),
    ("“门开了吗？”Zuld问道。他说：“快走！”谁数过22个箱子？价格是3.54元！", ["“门开了吗？”Zuld问道。", "他说：“快走！”", "谁数过22个箱子？", "价格是3.54元！"]),
    ("「準備は？」とLeeは聞きました。本当ですか？", ["「準備は？」とLeeは聞きました。", "本当ですか？"]),
    ("ราคา3.50บาท คนสวนเปิดถนนว่าง", ["ราคา3.50บาท", "คนสวนเปิดถนนว่าง"]),
    ("हरा संदूक गिना (330)। डॉ. Krotun 6 बजे आए।", ["हरा संदूक गिना (330)।", "डॉ. Krotun 6 बजे आए।"]),
    ("Πού είναι το κλειδί του Lee; Τι ωραία μέρα!", ["Πού είναι το κλειδί του Lee;", "Τι ωραία μέρα!"]),
    ("", []),
    (None, []),
    (" \n\n​ ", []),
]


def test_sentences(spark):
    frame = spark.createDataFrame([(f"{i:02d}", t, "x") for i, (t, _) in enumerate(SENTENCES)], "id string, generation string, sentence string")
    got = {}
    for r in sentences.sentences(frame.unionByName(frame)).orderBy("id", "sent_no").collect():
        got.setdefault(r.id, []).append(r.sentence)
        assert r.sent_no == len(got[r.id]) and SENTENCES[int(r.id)][0][r.start_char - 1 : r.end_char] == r.sentence
    assert [got.get(f"{i:02d}", []) for i in range(len(SENTENCES))] == [w for _, w in SENTENCES]


def test_sentences_lose_no_visible_character(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab A.?!…”“) \n。，คอ") for _ in range(120)) for _ in range(40)]
    frame = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, generation string")
    kept = {}
    for r in sentences.sentences(frame).orderBy("id", "sent_no").collect():
        kept[r.id] = kept.get(r.id, "") + r.sentence
    for i, t in enumerate(texts):
        assert "".join(kept.get(str(i), "").split()) == "".join(t.split())


# ---- 4


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(11)
    base = [words(rng, 75) for _ in range(12)]

    def edit(t, k):
        w = t.split()
        for i in rng.sample(range(len(w)), k):
            w[i] = words(rng, 1)
        return " ".join(w)

    rows = []
    for i, t in enumerate(base):
        rows += [(f"t{i:02d}", "train", t), (f"e{i:02d}", "test" if i % 2 else "validation", t.upper() if i % 3 == 0 else edit(t, 4) if i % 3 == 1 else words(rng, 75))]
    rows += [("z1", "train", base[0].replace("a", "а")), ("z2", "test", "​".join(base[1])), ("z3", "test", None), ("z4", "test", ""), ("z5", "test", "short"), (None, "test", base[0]), ("z6", None, base[0])]
    frame = spark.createDataFrame([(i, s, "src", t) for i, s, t in rows], "id string, split_name string, source_id string, generation string")
    frame = frame.unionByName(frame)
    good = [(i, s, overlap.comparable_words(t)) for i, s, t in rows if i and s and t and sum(map(str.isalnum, t)) >= 300]
    want = {tuple(sorted((a, b))) for a, s, x in good if s == "train" for b, q, y in good if q != "train" and overlap.agreement(x, y) >= 0.7}
    got = {(r.id_1, r.id_2) for r in overlap.overlapping_records(frame).collect()}
    assert got == want and len(want) >= 9
    report = overlap.overlap_report(frame).collect()
    assert sum(r.pairs for r in report) == len(want)
    assert overlap.overlapping_records(frame.where("false")).count() == 0


@pytest.mark.parametrize("alphabet", ["words", "characters"])
@pytest.mark.parametrize("share", [0.70, 0.75, 0.80, 0.85, 0.90])
def test_scattered_changes_are_candidates(share, alphabet):
    """Pairs in which single words (characters) differ at scattered places share a band and pass the sketch."""
    rng = random.Random(7)
    draw = (lambda: words(rng, 1)) if alphabet == "words" else (lambda: chr(0x4E00 + rng.randrange(2000)))
    n, k = 300, 300 if alphabet == "characters" else 80
    texts = []
    for _ in range(n):
        a = [draw() for _ in range(k)]
        b = list(a)
        for i in rng.sample(range(k), round((1 - share) * k)):
            b[i] = draw()
        assert overlap.agreement(a, b) >= share - 1e-9
        texts += [a, b]
    hashes = np.array([overlap._WORDS[w] for t in texts for w in t], dtype=np.uint64)
    counts = np.array([len(t) for t in texts])
    held = np.bincount([int(overlap._WORDS[w]) % overlap.COUNTERS for t in texts for w in set(t)], minlength=overlap.COUNTERS)
    bands, marks = overlap.signatures(counts, hashes, overlap.word_weights(held, len(texts)))
    alike = overlap.unlike(marks[::2], marks[1::2]) <= overlap.most_unlike(0.7)
    met = sum(bool((bands[2 * t] == bands[2 * t + 1]).any()) and alike[t] for t in range(n)) / n
    print("recall", alphabet, share, met)
    assert met >= (0.96 if share == 0.70 else 0.98)


def test_overlaps_with_scattered_changes(spark):
    rng = random.Random(12)
    rows = []
    for i in range(20):
        t = words(rng, 80).split()
        other = list(t)
        for k in rng.sample(range(80), 20):
            other[k] = words(rng, 1)
        rows += [(f"t{i:02d}", "train", "s", " ".join(t)), (f"e{i:02d}", "test", "s", " ".join(other))]
    frame = spark.createDataFrame(rows, "id string, split_name string, source_id string, generation string")
    assert {(r.id_1, r.id_2) for r in overlap.overlapping_records(frame).collect()} == {(f"e{i:02d}", f"t{i:02d}") for i in range(20)}


def test_copies_with_the_rarest_words_exchanged():
    """The hardest change for weights by rarity, at agreement 0.80: two thirds of the rare words, and no other, are exchanged."""
    rng = random.Random(23)
    common, rare = words(rng, 60).split(), words(rng, 4000).split()
    texts = []
    for _ in range(300):
        a = [rng.choice(common) for _ in range(70)] + [rng.choice(rare) for _ in range(30)]
        rng.shuffle(a)
        b = list(a)
        for i in [i for i, w in enumerate(a) if w not in common][:20]:
            b[i] = rng.choice(rare)
        texts += [a, b]
    uses = np.bincount([int(overlap._WORDS[w]) % overlap.COUNTERS for t in texts for w in t], minlength=overlap.COUNTERS)
    bands, marks = overlap.signatures(np.array([len(t) for t in texts]), np.array([overlap._WORDS[w] for t in texts for w in t], dtype=np.uint64), overlap.word_weights(uses, len(texts)))
    met = ((bands[::2] == bands[1::2]).any(axis=1) & (overlap.unlike(marks[::2], marks[1::2]) <= overlap.most_unlike(0.7))).mean()
    print("recall where the rarest words are exchanged", met)
    assert met >= 0.80


def test_common_words_equal_table():
    rng = random.Random(2)
    for _ in range(50):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 14))] for _ in range(2))
        t = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        assert overlap.common_words(a, b) == t[-1, -1]


def test_subsequences_side_by_side():
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 6, n, dtype=np.uint8) for n in (0, 1, 3, 63, 64, 65, 127, 128, 129, 200, 400)]
    pairs = [(a, b) for a in texts for b in texts]
    got = overlap.subsequences([a for a, _ in pairs], [b for _, b in pairs])
    assert got.tolist() == [overlap.common_words(a.tolist(), b.tolist()) for a, b in pairs]
    huge = [rng.integers(0, 250, 3000, dtype=np.uint8)] * 2
    assert overlap.subsequences([huge[0]], [huge[1]]).tolist() == [3000]


def test_words_of_many_texts_equal_those_of_one(monkeypatch):
    """Every character, alone and among others, gives the same words looked up in a table as by the patterns."""
    rng = random.Random(37)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(map(chr, points[k : k + 50])) for k in range(0, len(points), 50)] + [f"x{chr(c)}x {chr(c)}" for c in points if c < 0x3400]
    texts += ["".join(map(chr, rng.sample(points, 80))) for _ in range(200)] + ["", "Don't `stop`_now", "字", "a字b", "ก", "’", "e\u200b\u0301", "ﬁn…"]
    assert overlap.all_comparable_words(texts) == [overlap.comparable_words(t) for t in texts] and overlap.all_comparable_words([]) == []
    for t in texts[-8:]:
        folded = unicodedata.normalize("NFKC", t.translate(overlap._DROP)).translate(overlap._DROP).casefold().translate(overlap._SAME)
        assert overlap.comparable_words(t) == overlap._TOKEN.findall(folded)
    monkeypatch.setattr(overlap, "LOOKED_UP", 100)
    assert overlap.all_comparable_words(texts[-300:]) == [overlap.comparable_words(t) for t in texts[-300:]]


def test_subsequences_at_the_ends_of_words():
    """Lengths around whole words of bits; a pair given up lies below what it needs, one that isn't is exact."""
    rng = np.random.default_rng(41)
    sizes = [1, 2, 62, 63, 64, 125, 126, 127, 128, 189, 190, 300]
    pairs = [(rng.integers(0, letters, n).astype(np.uint8), rng.integers(0, letters, m).astype(np.uint8)) for n in sizes for m in sizes for letters in (1, 3, 250)]
    want = np.array([overlap.common_words(a.tolist(), b.tolist()) for a, b in pairs])
    assert overlap.subsequences(*map(list, zip(*pairs, strict=True))).tolist() == want.tolist()
    for share in (0.3, 0.7, 1.0):
        need = np.array([share * max(len(a), len(b)) for a, b in pairs])
        got = overlap.subsequences(*map(list, zip(*pairs, strict=True)), need)
        assert (got[want >= need] == want[want >= need]).all() and (got[want < need] < need[want < need]).all()


def test_screen_lets_every_key_through(spark):
    keys = spark.range(0, 5000).select((F.xxhash64("id")).alias("k"))
    bits = screen.screen(keys, "k", screen.bits_for(5000))
    mine = np.array([r.k for r in keys.collect()])
    assert screen.passes(bits, mine).all() and screen.passes(bits, np.arange(1, 20000)).mean() < 0.02
    assert not screen.passes(screen.screen(keys.where("false"), "k", 1 << 20), mine).any()


# ---- 5


@pytest.mark.parametrize("by", ["id", "source_id"])
def test_sample_is_stable(spark, by):
    rows = [(f"r{i}", uid(i // 4) if i % 7 else None, i) for i in range(2000)]
    frame = spark.createDataFrame(rows, "id string, source_id string, n int").withColumn("loaded_at", F.expr("timestamp_seconds(n)"))
    first = {r.id for r in sampling.stable_sample(frame.where("n < 1000"), 0.2, by).collect()}
    again = frame.unionByName(frame.withColumn("loaded_at", F.expr("timestamp_seconds(n + 9)"))).unionByName(frame.where("n = 0").withColumn("id", F.lit(None).cast("string")))
    second = sampling.stable_sample(again.repartition(7), 0.2, by).collect()
    ids = [r.id for r in second]
    assert len(ids) == len(set(ids)) and first <= set(ids) and abs(len(ids) / 2000 - 0.2) < 0.05
    assert all(r.loaded_at.timestamp() == int(r.id[1:]) for r in second)
    assert sampling.stable_sample(again, 0.0, by).count() == 0 and sampling.stable_sample(again, 1.0, by).count() == 2000
    assert sampling.stable_sample(frame.where("false"), 0.5, by).count() == 0
    with pytest.raises(ValueError):
        sampling.stable_sample(frame, 1.5, by)


# ---- 6 and 7

COMPLETE = [
    "The keeper counted lamps. Nobody watched the road.",
    "Take this:\n- 3 cups of flour\n- 2 cups of butter",
    "The road was long.\n\nYours,\nHeld",
    "Read it here. Read more: https://a.example/b",
    "All went well. Thanks for reading 🙂",
    "คนสวนเปิดถนนว่าง คนสวนเปิดถนน",
    "She called it “a find.”",
    "n/a",
    "Write about lamps",
    "",
    None,
]
CUT = ["The keeper counted lamps. Nobody watched the ro", "The keeper counted lamps. Nobody watched the", "The keeper counted lamps. Nobody watched th [truncated]", "The keeper counted lamps. Nobody watc…", "The keeper counted lamps, and then,", "पुराना पुल दिखाया। माली ने बारि�"]


def test_truncation(spark):
    filler = [(f"f{i}", None, "Nobody watched the road. The keeper counted lamps. They keep flour, butter and roads.\n- 1 cup of butter\n- 1 cup of flour\nDone.", "m") for i in range(3)]
    rows = [(f"c{i}", "Write about lamps.", t, "m") for i, t in enumerate(COMPLETE)] + [(f"x{i}", "Write about lamps.", t, " M") for i, t in enumerate(CUT)] + filler
    frame = spark.createDataFrame(rows, "id string, prompt string, generation string, model string")
    got = {r.id: r.evidence for r in truncation.truncated(frame.unionByName(frame)).collect()}
    assert set(got) == {f"x{i}" for i in range(len(CUT))}
    assert got["x0"] == "inside_word" and got["x1"] == "inside_sentence" and got["x2"] == "mark" and got["x5"] == "inside_character"
    report = truncation.truncation_by_model(frame).collect()
    assert [(r.model, r.records, r.truncated) for r in report] == [("m", len(rows), len(CUT))]
    assert truncation.truncated(frame.where("false")).count() == 0


def test_truncation_rests_on_the_vocabulary(spark):
    """Without known words nothing but marks and half characters speaks for a cut; a complete last word at a common length is no cut."""
    rows = [(f"x{i}", "Write about lamps.", t) for i, t in enumerate(CUT)]
    frame = spark.createDataFrame(rows, "id string, prompt string, generation string")
    ends = truncation.open_ends(frame, ["id"], "generation", "prompt")
    none = spark.createDataFrame([], "word string, n long, final long, dots long")
    assert {r.evidence for r in truncation.judge(ends, none, ["id"]).collect()} <= {"mark", "inside_character", "inside_sentence"}
    assert {r.id for r in truncation.judge(ends, none, ["id"]).collect()} == {"x2", "x4", "x5"}
    words = spark.createDataFrame([("lamps", 100, 90, 0), ("watched", 100, 0, 0), ("lighthouse", 50, 5, 0), ("the", 900, 0, 0)], "word string, n long, final long, dots long")
    ends = spark.createDataFrame([(f"e{i}", "open", "lamps") for i in range(30)] + [("w", "open", "watched"), ("f", "open", "lightho")], "id string, state string, word string")
    assert {r.id: r.evidence for r in truncation.judge(ends, words, ["id"]).collect()} == {"w": "inside_sentence", "f": "inside_word"}
    piled = spark.createDataFrame([(f"e{i}", "open", "lamps", 512 if i < 20 else 300 + i) for i in range(40)], "id string, state string, word string, length int")
    ratios = spark.createDataFrame([(512, 4096.0)], "length int, ratio double")
    assert {r.id for r in truncation.judge(piled, words, ["id", "length"], ratios).collect()} == {f"e{i}" for i in range(20)}


def test_delimiters_and_long_refusals():
    assert D.unclosed("He said (and [so") and not D.unclosed("a) b (c) [d]")
    assert D.cut_state("All was well. The keeper (who had seen the lamps")[0] == "cut" and D.cut_state("Yes (2) and b). The keeper of lamps in town")[0] == "open"
    long = " ".join(["I'm sorry, but I can't help with that request.", "I cannot give any details of it.", "It would not be right."] * 9)
    assert len(long) > 800 and D.is_refusal(long) and not D.is_refusal(long + " The lamp was built in May." * 30)


ANSWERS = [
    ("Yes.", None),
    ("No, hardly ever.", None),
    ("I'm sorry to hear that. The lamp broke at noon, and nobody came to mend it.", None),
    ("I cannot say enough good things about lamps. They are the best thing in the house.", None),
    ("I'm sorry, but I can't help with that request.", "refusal"),
    ("Sorry, I’d rather not discuss lamps here... Please try another question.", "refusal"),
    ("Es tut mir leid, dabei kann ich leider nicht helfen.", "refusal"),
    ("WHY DOES THE KEEPER NEED A NEW LAMP NEAR THE HARBOUR?", "copy"),
    ("Question: Why does the keeper need a new lamp near the harbour?\n\nAnswer:", "copy"),
    ("Why does the keeper want a new lamp near the village?", "copy"),
    ("Why does the keeper need a new lamp near the harbour? The old one broke in the storm last winter.", None),
    ("Die Bäckerin öffnete den grünen Koffer und die Lehrerin suchte das Gerät.", "other_language"),
    ("[removed]", "empty"),
    ("​", "empty"),
    (None, "empty"),
    ("The old lamp broke in the storm. The keep", "truncated"),
]


def test_defective_pairs(spark):
    prompt = "Why does the keeper need a new lamp near the harbour?"
    raid = spark.createDataFrame([("a1", prompt, "The keeper needs it for the ships. The keeper said so."), ("a2", None, "[removed]"), ("a3", "Report on it. Answer in German.", "The keeper needs it for the ships and the road."), ("a4", prompt, "")], "id string, prompt string, generation string")
    hc3 = spark.createDataFrame([(7, prompt, [t for t, _ in ANSWERS], []), (8, prompt, None, ["Yes."])], "q_id long, question string, human_answers array<string>, chatgpt_answers array<string>")
    got = {(r.rec_id, r.side, r.answer_no): r.defect for r in pairs.defective_pairs(raid.unionByName(raid), hc3.unionByName(hc3)).collect()}
    want = {("7", "human_answers", i): d for i, (_, d) in enumerate(ANSWERS) if d} | {("7", "chatgpt_answers", -1): "empty", ("8", "human_answers", -1): "empty", ("a3", "generation", 0): "other_language", ("a4", "generation", 0): "empty"}
    assert got == want
    assert pairs.defective_pairs(raid.where("false"), hc3.where("false")).count() == 0


def test_suffix_automaton_runs():
    rng = random.Random(5)
    for _ in range(60):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(2))
        runs = {tuple(a[i:j]) for i in range(len(a)) for j in range(i + 1, len(a) + 1)}
        want = [max((k for k in range(1, i + 2) if tuple(b[i + 1 - k : i + 1]) in runs), default=0) for i in range(len(b))]
        assert D.SuffixAutomaton(a).runs(b) == want


TRAINING = [
    "The article in the paper was written for the people of the town, and it said that the writer had to write it with care at night.",
    "She wrote that the title of the new story was not what they had thought, as the news from the town came with the ship.",
    "L'article dans le journal a été écrit pour les habitants de la ville, et il est dit que l'auteur ne l'a pas intitulé avec soin.",
    "Elle a écrit dans le cahier que le titre de la nouvelle est plus court, et qu'il ne faut pas écrire sur les murs de la maison.",
    "El artículo en el periódico fue escrito para los habitantes de la ciudad, y no se sabe por qué el autor lo ha titulado así con su nombre.",
]


def test_languages():
    assert language.language("Die Lehrerin suchte das Gerät und den Koffer.") == "de"
    assert language.language("疲れた使者は古い箱を売りました。") == "ja" and language.language("旅人卖掉了沉重的钥匙。") == "zh"
    assert language.asked_language('Report on "The Lamp of Held". Answer in Japanese.') == "ja" 
    model = language.LetterModel(TRAINING)
    assert language.asked_language("Écris un article intitulé « The Lamp ».", model) == "fr" and language.asked_language("Write a news article titled « Le Phare ».", model) == "en"
    assert language.LetterModel([]).language("Écris un article") is None
    assert language.language("Held 12") is None


# ---- 8


def test_leaks(spark):
    rng = random.Random(8)
    items = [words(rng, 60) for _ in range(5)]
    w = [t.split() for t in items]

    def near(part, k):
        part = list(part)
        for i in range(5, len(part), len(part) // k):
            part[i] = "zzz"
        return part

    docs = [
        (1, words(rng, 20) + " " + " ".join(w[0][10:45]) + " " + words(rng, 20), 0),
        (2, words(rng, 20) + "\n> " + "\n> ".join([" ".join(w[1][:20]).upper(), " ".join(w[1][20:40])]) + "\n", 1),
        (3, " ".join(near(w[2][5:50], 4)), 2),
        (4, " ".join(w[3][:22]) + " " + words(rng, 30), None),
        (5, None, None), (6, "", None), (7, words(rng, 80), None),
        (8, " ".join(w[4][:20]) + "\n\nA: " + " ".join(w[4][20:40]), 4),
    ]
    d = spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id long, text string")
    e = spark.createDataFrame([(i, "s", "en", t) for i, t in enumerate(items)], "item_id long, item_set string, lang string, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.leaked_items(d.unionByName(d), e).collect()}
    assert got == {(i, k) for i, _, k in docs if k is not None}
    assert leakage.leaked_items(d.where("false"), e).count() == 0 and leakage.leaked_items(d, e.where("false")).count() == 0
    assert {r.item_id: r.documents for r in leakage.leak_report(d, e).collect()} == {0: 1, 1: 1, 2: 1, 3: 0, 4: 1}


@pytest.mark.parametrize("copies", [4, 8, 40])
def test_frequent_passages_stay_found(spark, copies):
    """Passages of few different words, however many documents hold them; more documents never hide one."""
    rng = random.Random(18)
    phrase = words(rng, 6)
    changed = words(rng, 40).split()
    items = [words(rng, 20) + " " + " ".join([phrase] * 6) + " " + words(rng, 20), words(rng, 9) + " " + " ".join(changed) + " " + words(rng, 9)]
    middle = [("zz" if k in (12, 17, 22, 27) else w) for k, w in enumerate(changed)]  # 4 of 40, all in the middle
    docs = [(k, words(rng, 15) + " " + " ".join([phrase] * 6) + " " + words(rng, 15)) for k in range(copies)] + [(100 + k, " ".join(middle)) for k in range(copies)]
    docs += [(200, " ".join(changed[:29])), (201, " ".join("zz" if k in (3, 9, 15, 21) else w for k, w in enumerate(changed[:31])))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    e = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.leaked_items(d, e).collect()}
    assert got == {(k, 0) for k in range(copies)} | {(100 + k, 1) for k in range(copies)}


def test_longest_passage_equals_brute_force():
    """Exact on stretches without gaps, whatever scores better elsewhere."""
    rng = random.Random(28)
    for _ in range(40):
        item = [rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60)]
        part = item[10 : 10 + rng.randint(25, 45)]
        for i in rng.sample(range(len(part)), rng.randint(0, 5)):
            part[i] = "?"
        doc = ["."] * 5 + part + ["!"] * 8 + item[:29]
        want = 0
        for shift in range(-len(item), len(doc)):
            good = [doc[j + shift] == item[j] for j in range(len(item)) if 0 <= j + shift < len(doc)]
            want = max([want, *(b - a for a in range(len(good)) for b in range(a + 1, len(good) + 1) if 10 * (b - a - sum(good[a:b])) <= b - a)])
        got = leakage.longest_passage(doc, item)
        assert got >= want if want >= 30 else got < 30 or got >= want


# ---- 9


def test_mixture_meets_targets(spark):
    rng = random.Random(9)
    rows = []
    for i in range(400):
        s = "a" if i < 260 else "b" if i < 380 else "c"
        rows.append((i, s, f"{s * 4} " + words(rng, 20)))
    rows += [(900, "a", rows[0][2]), (901, None, "x y"), (902, "b", None), (903, "b", "  ")]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string")
    t = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 2), ("c", 0.1, 4), ("gone", 0.1, 3)], "source string, target_share double, max_repeats int")
    got = {r.source: r for r in mixing.mixture_shares(d, t).collect()}
    for s, share in (("a", 0.5 / 0.9), ("b", 0.3 / 0.9), ("c", 0.1 / 0.9)):
        assert got[s].goal_share == pytest.approx(share) and got[s].share == pytest.approx(share, abs=0.03) and got[s].most_copies <= got[s].max_repeats
    assert got["gone"].tokens_used == 0
    mix = mixing.mixture(d, t).toPandas()
    assert mix.doc_id.is_unique and 900 not in set(mix.doc_id) and (mix.copies > 0).all()


def test_classifier_and_memberships(spark):
    """Held-out rows tell whether texts show their source; expected totals meet the targets by the memberships."""
    rng = random.Random(19)
    own = {s: [words(rng, 1) for _ in range(60)] for s in "abc"}
    rows = [(i, s, " ".join(rng.choice(own[s]) for _ in range(20))) for i, s in enumerate(rng.choice("abbccc") for _ in range(900))]
    blind = [(i, s, words(rng, 20)) for i, s, _ in rows]
    model = mixing.Classifier([t for _, _, t in rows], [s for _, s, _ in rows], list("abc"))
    assert model.trust > 0.9 and (model.posterior([t for _, _, t in rows[:50]]).argmax(axis=1) == ["abc".index(s) for _, s, _ in rows[:50]]).mean() > 0.95
    assert mixing.Classifier([t for _, _, t in blind], [s for _, s, _ in blind], list("abc")).trust < 0.1
    # a fifth of the texts stands under a wrong label; both totals are fitted
    noisy = [(i, rng.choice("abc") if i % 5 == 0 else s, t) for i, s, t in rows]
    d = spark.createDataFrame(noisy, "doc_id long, source string, text string")
    t = spark.createDataFrame([("a", 0.4, 3), ("b", 0.3, 3), ("c", 0.3, 3)], "source string, target_share double, max_repeats int")
    got = mixing.mixture_shares(d, t).collect()
    assert max(abs(r.labelled_gap) for r in got) < 0.01 and max(abs(r.expected_gap) for r in got) < 0.01 and got[0].trust > 0.3
    assert mixing.mixture(d.where("false"), t).count() == 0


# ---- 10


def test_garbled_text_comes_back(spark):
    clean = ["Die Bäckerin öffnete den größeren Koffer während der Messe in Held.", "Une voyageuse a vérifié la récolte précoce à cause de la pluie.", "Строгий сторож продал сладкий пирог рано утром.", "Ο γέρος μυλωνάς άνοιξε τον άδειο δρόμο στη γιορτή."]
    rows = [(i, clean[i % 4] + f" Nr {i // 4}.") for i in range(80)]
    bad = [(100 + i, (clean[0] + " Ende.").encode().decode(c)) for i, c in enumerate(("cp1252", "latin-1", "mac-roman"))]
    bad += [(110, clean[0].encode().decode("latin-1")), (114, "Die B\ufffdckerin kam.")]
    # no sentence of these has a twin: two documents show each transformation
    bad += [(120 + k, (clean[1] + f" Fin {k}.").encode().decode("latin-1").encode().decode("latin-1")) for k in range(2)]
    bad += [(130 + k, (clean[2] + f" Да {k}.").encode("koi8-r").decode("cp1251")) for k in range(2)]
    bad += [(140 + k, (clean[3] + f" {k}.").encode("iso8859-7").decode("latin-1")) for k in range(2)]
    sound = [(200, "The manual lists “â€™” among the signs."), (201, "Write &eacute; and &amp; here."), (202, "Łódka costs 20 °C, ½ cup and £35 — über-careful."), (203, None), (204, ""), (205, 'The word showed up as "cafÃ©", he said.')]
    d = spark.createDataFrame(rows + bad + sound, "doc_id long, text string")
    got = {r.doc_id: r for r in encoding.garbled_documents(d.unionByName(d)).collect()}
    assert set(got) == {i for i, _ in bad}
    assert got[100].restored == clean[0] + " Ende." and got[110].restored == clean[0] and got[130].restored.startswith(clean[2]) and not got[114].whole
    learned = {r.transformation for r in encoding.learned_transformations(d).collect()}
    assert "utf-8 as latin-1" in learned
    assert encoding.garbled_documents(d.where("false")).count() == 0


def test_a_large_garbled_group_is_found(spark):
    """Garbled apostrophes outnumber the right ones; neither copies nor different sentences hide them."""
    fine = [(i, f"It’s the keeper’s lamp number {i} that glows.") for i in range(5)]
    garbled = [(100 + i, f"That’s not Anna’s boat but Peter’s, entry {i // 2}.".encode().decode("cp1252")) for i in range(40)]
    d = spark.createDataFrame(fine + garbled, "doc_id long, text string")
    assert {r.doc_id for r in encoding.garbled_documents(d).collect()} == {i for i, _ in garbled}


def test_twins_show_swaps_of_few_letters(spark):
    """Four accents read in another code page are too few without twins; one twin shows the swap."""
    text = "Der Müller trägt größere Körbe zum alten Hafen"
    sound = [(i, f"Der Müller trägt größere Körbe zum alten Hafen Nr {i}.") for i in range(30)]
    swapped = [(100, (text + " Nr 3.").encode("mac-roman").decode("cp1252")), (101, "Die Körbe der Müller im Süden.".encode("mac-roman").decode("cp1252"))]
    d = spark.createDataFrame(sound + swapped, "doc_id long, text string")
    assert "mac-roman as cp1252" in {r.transformation for r in encoding.learned_transformations(d).collect()}
    assert {r.doc_id for r in encoding.garbled_documents(d).collect()} == {100, 101}


def test_learned_transformations_find_what_likeness_cannot(spark):
    """Two misread letters are found, restored and marked once a twin shows the transformation, and are not without it."""
    sound = [(i, f"Der Müller trägt größere Körbe zum alten Hafen Nr {i}. Im Süden steht eine Mühle für Öl.") for i in range(30)]
    twin = [(100, "Der Müller trägt größere Körbe zum alten Hafen Nr 3.".encode().decode("cp1252"))]
    lone = [(101, "The mill by the Süden road.".encode().decode("cp1252")), (102, "Körbe sold here.".encode().decode("cp1252"))]
    schema = "doc_id long, text string"
    assert encoding.garbled_documents(spark.createDataFrame(sound + lone, schema)).count() == 0
    got = {r.doc_id: r for r in encoding.garbled_documents(spark.createDataFrame(sound + lone + twin, schema)).collect()}
    assert set(got) == {100, 101, 102} and {r.evidence for r in got.values()} == {"twins"}
    assert got[101].restored == "The mill by the Süden road." and got[102].restored == "Körbe sold here."


def test_single_byte_twins_without_ascii_words(spark):
    """Sentences of another script meet their twins by the lengths of their words."""
    text = "Строгий сторож продал сладкий пирог рано утром (58{})."
    rows = [(i, text.format(i)) for i in range(20)] + [(100, text.format(7).encode("koi8-r").decode("cp1251"))]
    learned = {r.transformation for r in encoding.learned_transformations(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "koi8-r as cp1251" in learned


def test_a_twin_is_met_among_many_forms(spark):
    """The right form of a garbled sentence counts, however many others have the same letters outside their accents."""
    text = "The miller M{}ller has a long way to the mill."
    rows = [(i, text.format(chr(0xE0 + i))) for i in range(29)] + [(100, text.format("ü").encode().decode("cp1252"))]
    learned = {r.transformation for r in encoding.learned_transformations(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "utf-8 as cp1252" in learned


def test_twins_equal_brute_force(spark):
    """Every pair with a key in common that a transformation explains is counted."""
    rng = random.Random(31)
    letters = "äöüéèñçøåß"
    texts = {f"The k{rng.choice(letters)}per of l{rng.choice(letters)}mps m{rng.choice(letters)}t {rng.randrange(2)} friends" for _ in range(60)}
    texts |= {" ".join("".join(rng.choice("абве") for _ in range(2)) for _ in range(5)) for _ in range(60)}
    texts |= {t.encode(w, "replace").decode(r, "replace") for t in sorted(texts) for w, r in (rng.choice([("utf-8", "cp1252"), ("mac-roman", "cp1252"), ("koi8-r", "cp1251")]),)}
    documents = spark.createDataFrame(list(enumerate(sorted(texts))), "doc_id long, text string")
    likeness = encoding.Detector(encoding.collected_counts(documents)).likeness
    keyed = [(k, t) for t in texts if not t.isascii() for k in (*encoding.twin_keys(t), encoding.text_key(t)) if k]
    want = Counter(name for k, a in keyed for q, b in keyed if k == q and a != b for name in encoding.explain(a, b, likeness))
    assert max(Counter(k for k, _ in keyed).values()) > 20 and len(want) > 2
    assert {r.transformation: r.twins for r in encoding.learned_transformations(documents).collect()} == want


@pytest.mark.parametrize("codec", encoding.MISREAD)
def test_misread_round_trip(codec):
    text = "über Żółć – “naïve” жаба 水"
    chars = encoding._byte_chars(codec)
    garbled = "".join(chars[b] if b >= 0x80 else chr(b) for b in text.encode())
    if len(set(chars.values())) == 128:
        assert encoding.transformations()[f"utf-8 as {codec}"].restore(garbled) == text
