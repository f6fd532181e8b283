from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lexidrift.functions import constants as K
from lexidrift.functions import integrity as I
from lexidrift.functions import metrics as M
from lexidrift.operators import cells as C
from lexidrift.operators import comparison as X
from lexidrift.operators import echo as E
from lexidrift.operators import records as R
from lexidrift.operators import resampling as S
from lexidrift.sources import readers, writers

PARAMS = S.ClusterParams(0.0132, 15.0, 1.476, 0.026, "fixture")


def test_lifts_reproduce_published_rows(spark):
    # occurrences and sentences of two arms, and the published lift
    rows = [(27, 4348, 0, 5096, 64.4596), (7, 5512, 0, 5096, 13.8681), (0, 1151, 0, 1076, 0.9349), (4, 100, 0, 100, 9.0)]
    frame = spark.createDataFrame(rows, "a long, n long, b long, m long, want double")
    got = frame.select(F.round(M.smoothed_lift(F.col("a"), F.col("n"), F.col("b"), F.col("m")), 4).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_ratio_of_nothing_is_zero_and_negative_denominators_fail(spark):
    frame = spark.createDataFrame([(3, 0)], "a long, n long")
    assert frame.select(M.ratio(F.col("a"), F.col("n"))).first()[0] == 0.0
    with pytest.raises(Exception, match="negative"):
        frame.select(M.smoothed_rate(F.col("a"), F.lit(-1))).collect()


def test_three_corpora(spark):
    docs = [("ai", 1, "It is not speed, but time."), ("ai", 2, "It is not cost, but value."), ("pre", 1, "A red ball."), ("pre", 2, ""), ("contemporary", 1, "One day."), ("contemporary", 2, None)]
    got = X.ranked(X.compared(spark.createDataFrame(docs, "corpus string, doc_id int, text string"))).collect()
    frame = next(r for r in got if r.pattern == "not <X> but <Y>")
    assert frame.lift_vs_pre_human_smoothed > 1 and frame.lift_vs_contemporary_human_smoothed > 1 and frame.ai_documents_with == 2
    assert X.ranked(X.compared(spark.createDataFrame([], "corpus string, doc_id int, text string"))).count() == 0


def test_verdicts(spark):
    rows = [("a", 2.0, 2.0, 0.2, 9), ("b", 2.0, 2.0, 0.05, 9), ("c", 1.0, 1.0, 0.2, 9), ("d", 1.0, 2.0, 0.2, 9)]
    frame = spark.createDataFrame(rows, "pattern string, lift_discovery_vs_human double, lift_validation_vs_human double, validation_doc_prevalence double, validation_occurrences long")
    got = {r.pattern: r.verdict for r in X.with_verdicts(frame).collect()}
    assert got == {"a": "REPLICATED", "b": "FAILED_VALIDATION", "c": "NOT_ELEVATED", "d": "REPLICATED"}


def echo_rows(spark, prompt, title, kind, pattern, n):
    sets = E.echo_sets(spark.createDataFrame([("s", title, prompt)], "source_id string, title string, prompt string"))
    rows = spark.createDataFrame([("s", kind, pattern, n)], "source_id string, kind string, pattern string, n long")
    return E.echo_counts(E.mark_echoes(rows, sets), ["kind", "pattern"]).first()


@pytest.mark.parametrize(
    ("prompt", "title", "kind", "pattern", "n", "echoing", "derived"),
    [
        ("Write a news article titled Bees", "Bees", K.NGRAM, "news article", 3, 3, True),
        ("Write a news article titled Bees", "Bees", K.NGRAM, "unrelated phrase", 3, 0, False),
        ("It was not about money but about trust.", "", K.WITHIN, "not about <X> but about", 2, 2, True),
        ("It was not about money but about trust.", None, K.NGRAM, "about cost but", 1, 0, False),
        ("a news article", "", K.CROSS, "not a <X> but", 4, 0, False),
        ("It is not a storm but a shower.", "", K.CROSS, "not a <X> but a <X>", 2, 2, True),
        (None, None, K.NGRAM, "news article", 1, 0, False),
    ],
)
def test_echoes(spark, prompt, title, kind, pattern, n, echoing, derived):
    row = echo_rows(spark, prompt, title, kind, pattern, n)
    assert (row.total, row.echoing, row.primary, row.prompt_derived) == (n, echoing, n - echoing, derived)


def raid(spark, rows):
    names = ("id", "source_id", "model", "domain", "attack", "decoding", "repetition_penalty", "prompt", "title", "generation")
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))


def uid(n):
    return f"{n:032x}"


def make(n, source, model, domain="news", text="x" * 400, decoding="greedy", penalty="no"):
    return (uid(n), source, model, domain, "none", decoding, penalty, "p", "t", text)


def test_records_are_tidied_and_counted_once(spark):
    a = make(1, "{" + uid(9).upper() + "} ", " Llama_Chat ", "News ")
    got = R.records(raid(spark, [a, a, (None,) + a[1:], make(2, "unknown", None)])).orderBy("id").collect()
    assert [(r.source_id, r.model, r.domain) for r in got] == [(uid(9), "llama-chat", "news"), (None, None, "news")]


def test_length_floor_counts_code_points_without_outer_space(spark):
    frame = spark.createDataFrame([(" " + "ä" * 400 + "\n",), ("a" * 399 + " ",), (None,)], "t string")
    assert [r[0] for r in frame.select(R.long_enough(F.col("t"))).collect()] == [True, False, False]


def test_phases_are_disjoint_and_too_few_sources_fail(spark):
    rows = [make(i, uid(100 + i), "human", decoding=None, penalty=None) for i in range(6)]
    found = R.complete_sources(R.records(raid(spark, rows)), ("human",))
    split = R.phases(found, 3)
    assert split.groupBy("phase").count().orderBy("phase").collect() == [("discovery", 3), ("validation", 3)]
    with pytest.raises(Exception, match="too few sources"):
        R.phases(found, 4).collect()
    none = spark.createDataFrame([], "source_id string")
    R.check_phases(split, none)
    with pytest.raises(ValueError, match="excluded"):
        R.check_phases(split, split.select("source_id").limit(1))


def test_division_needs_every_model(spark):
    rows = [make(1, uid(5), "human", decoding=None, penalty=None), make(2, uid(5), "chatgpt"), make(3, uid(6), "human", decoding="", penalty=""), make(4, uid(6), "chatgpt", penalty="yes")]
    got = R.complete_sources(R.records(raid(spark, rows)), ("human", "chatgpt")).collect()
    assert [r.source_id for r in got] == [uid(5)]


def test_survey_counts_unaltered_pairs(spark):
    got = {(r.field, r.value): r.rows for r in R.survey(R.records(raid(spark, [make(1, None, "gpt4"), make(2, None, None)]))).collect()}
    assert got["all", None] == 2 and got["model", "gpt4"] == 1 and got["model", None] == 1 and got["model/domain", "gpt4/news"] == 1


def test_second_study_end_to_end(spark):
    from lexidrift.plans.studies import SecondStudy

    rows, n = [], 0
    for d in K.CELL_DOMAINS:
        for k in range(4):
            source = uid(1000 + n)
            for m in ("human", *K.DISCOVERY_MODELS, *K.VALIDATION_MODELS):
                n += 1
                good = "It is not a storm but a shower. " * (1 if m == "human" and k == 0 else 0 if m == "human" else 3)
                rows.append(make(n, source, m, d, good + "Stones roll down hills. " * 20, *((None, None) if m == "human" else ("greedy", "no"))))
    study = R.second_study(raid(spark, rows), spark.createDataFrame([], "source_id string"), 2)
    assert study.count() == 5 * 2 * 2 * 4
    done = SecondStudy(study, spark.createDataFrame([], "source_id string, title string, prompt string"), C.SecondStudyRules(min_occurrences=6))
    fixed = {(r.kind, r.pattern) for r in done.candidates().collect()}
    assert (K.WITHIN, "not a <X> but a <X>") in fixed and not any("stones roll" == p for _, p in fixed)
    matrix = done.lift_matrix(resamples=200)
    assert matrix.count() == len(fixed) * 5 * 2 * 3
    row = matrix.where("pattern = 'not a <X> but a <X>' and phase = 'validation'").first()
    assert row.replicated_pattern and row.bootstrap_ci_lo <= row.lift <= row.bootstrap_ci_hi and row.occurrences == 6


def test_dispersion_and_nearest_rank(spark):
    frame = spark.createDataFrame([([0.0, 0.0, 6.0],)], "x array<double>")
    total, squares = F.lit(6.0), F.lit(36.0)
    assert frame.select(S.moment_dispersion(total, squares, F.lit(3))).first()[0] == pytest.approx((12 - 2) / 4)
    assert frame.select(S.moment_dispersion(F.lit(0.0), F.lit(0.0), F.lit(3))).first()[0] is None
    assert frame.select(S.nearest_rank(F.col("x"), 0.75)).first()[0] == 6.0
    assert frame.select(S.nearest_rank(F.array().cast("array<double>"), 0.5)).first()[0] is None


def test_power_chain(spark):
    """Flat where the effect lies on the threshold, sufficient at twice it, nothing without one; the published choice within chance."""
    low = [S.simulated_power(spark, PARAMS, n, 1.5, 40, 21) for n in (200, 851)]
    assert max(low) < 0.6 and abs(low[0] - low[1]) < 0.35
    assert S.simulated_power(spark, PARAMS, 200, 2.0, 40, 21) > 0.8
    assert [S.simulated_power(spark, PARAMS, 200, 1.0, 40, 21, shape) for shape in S.ASYMMETRIES] == [0.0, 0.0, 0.0]
    published = {50: 0.82, 60: 0.8745, 65: 0.893, 70: 0.904}
    curve = {r.sources: r.power for r in S.power_curve(spark, PARAMS, tuple(published)).collect()}
    assert all(abs(curve[n] - p) < 0.03 for n, p in published.items())
    again = {r.sources: r.power for r in S.power_curve(spark, PARAMS, tuple(published)).collect()}
    assert curve == again


def test_choice_of_sources(spark):
    row = {f"{name}_{tag}": v for name, v in (("base_rate_per_unit", 0.0132), ("source_dispersion", 1.476), ("model_dispersion", 0.026)) for tag in ("q1", "median", "q3")} | {"exposure_per_doc": 15.0}
    params, quartiles = S.measured(row, "a row")
    assert (params.base_rate_per_unit, params.exposure_per_doc) == (0.0132, 15.0) and len(quartiles) == 6
    assert S.select_sources(spark, S.sensitivity(params, quartiles), grid=(40, 60), extension=(70,)) == 60
    assert S.select_sources(spark, S.sensitivity(params, quartiles), grid=(20,), extension=(25,)) is None
    with pytest.raises(ValueError, match="model_dispersion"):
        S.measured(row | {"model_dispersion_median": None}, "a row")
    with pytest.raises(ValueError, match="852|at most"):
        S.simulated_power(spark, PARAMS, 852, 2.0, 10, 1)
    with pytest.raises(ValueError, match="base_rate_per_unit, provenance"):
        S.ClusterParams(0.0, 1.0, 0.0, 0.0, " ").validate()
    with pytest.raises(ValueError):
        S.select_sources(spark, [("point", PARAMS)], replicates=10)
    assert S.projected(10.0, 3404, 500) == {"documents": 34040, "seconds": 100.0, "skeletons_at_most": 5000}


def test_last_titles_and_phases(spark):
    sid = "0" * 31
    rows = [(sid + "1", None, "p"), (sid + "1", "A Title", ""), (sid + "1", "", "q"), (sid + "2", "", None), (None, "x", "y"), ("unknown", "x", "y")]
    got = {r.source_id: (r.title, r.prompt) for r in R.sources(spark.createDataFrame(rows, "source_id string, title string, prompt string")).collect()}
    assert got == {sid + "1": ("A Title", "q"), sid + "2": ("", "")}


def test_tallies_and_quantiles(spark):
    from lexidrift.functions.text import tallied

    rows = spark.createDataFrame([(["b", "a", "b"],), ([],), (None,), (["c"],)], "x array<string>")
    assert [[tuple(p) for p in r[0]] for r in rows.select(tallied(F.col("x"))).collect()] == [[("a", 1), ("b", 2)], [], [], [("c", 1)]]
    values = [3, 1, 2, 2, 5, 9, 9]
    tally = spark.createDataFrame([("g", v, values.count(v)) for v in set(values)], "g string, v long, n long")
    got = S.ranked_quantiles(tally, ["g"], "v", "n", {"lo": 0.25, "mid": 0.5, "hi": 0.75}).first()
    ordered = sorted(values)
    assert (got.lo, got.mid, got.hi) == tuple(ordered[min(int(q * 6 + 0.5), 6)] for q in (0.25, 0.5, 0.75))


def test_canonical_hashes(spark):
    same = ["a\nb\n", "a\r\nb", "a\rb\n\n\n"]
    assert len({I.text_sha256(t) for t in same}) == 1
    frame = spark.createDataFrame([(t,) for t in [*same, "", "\n\n", "\r\n"]], "t string")
    got = [r[0] for r in frame.select(I.canonical_text_sha256(F.col("t"))).collect()]
    assert got == [I.text_sha256(t) for t in [*same, "", "\n\n", "\r\n"]] and len(set(got[3:])) == 1
    assert I.json_sha256({"a": 1, "b": 2}) == I.json_sha256({"b": 2, "a": 1}) != I.json_sha256({"a": 2, "b": 2})
    assert I.anchors_sha256() == "2b712d70b3c0051b29fd9c5b3b760199c6f0ad216733a409489ab65874d3688b"
    with pytest.raises(TypeError):
        I.text_sha256(b"a")


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "docs/sub").mkdir(parents=True)
    (tmp_path / "docs/a.txt").write_bytes(b"One.\r\nTwo.")
    (tmp_path / "docs/sub/b.txt").write_text("Drei ä.", encoding="utf-8")
    (tmp_path / "docs/c.md").write_text("no")
    assert {r.text for r in readers.text_folder(spark, str(tmp_path / "docs")).collect()} == {"One.\nTwo.", "Drei ä."}
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        readers.text_folder(spark, str(tmp_path / "empty"))
    (tmp_path / "r.csv").write_text('id,extra,generation,model\n1,x,"line one\nsaid ""hi"", then",gpt4\n', encoding="utf-8")
    row = readers.records_csv(spark, str(tmp_path / "r.csv")).first()
    assert row.generation == 'line one\nsaid "hi", then' and row.model == "gpt4" and row.title is None
    (tmp_path / "h.jsonl").write_text('{"human_answers":["a"],"chatgpt_answers":[]}\n\n{"human_answers":["b"]}\n', encoding="utf-8")
    assert [(r.line_no, r.human_answers) for r in readers.answers_jsonl(spark, str(tmp_path / "h.jsonl")).orderBy("line_no").collect()] == [(0, ["a"]), (2, ["b"])]
    (tmp_path / "x.txt").write_text("# note\n\nabc\n", encoding="utf-8")
    assert [r.source_id for r in readers.exclusion_list(spark, str(tmp_path / "x.txt")).collect()] == ["abc"]
    base = tmp_path / "clusters/discovery/news/s1"
    base.mkdir(parents=True)
    for name in ("title", "prompt", "human", "gpt4"):
        (base / f"{name}.txt").write_text(name)
    docs, sources = readers.cluster_folder(spark, str(tmp_path / "clusters"))
    assert {(r.phase, r.domain, r.source_id, r.model) for r in docs.collect()} == {("discovery", "news", "s1", "human"), ("discovery", "news", "s1", "gpt4")}
    assert sources.first().title == "title"
    frame = spark.createDataFrame([("ngram", "b", 1), ("ngram", "a", 2)], "kind string, pattern string, domains long")
    assert writers.result_csv(frame.orderBy("pattern"), tmp_path / "out/r.csv") == 2
    assert (tmp_path / "out/r.csv").read_text().splitlines() == ["kind,pattern,domains", "ngram,a,2", "ngram,b,1"]
    assert writers.result_csv(frame.where("false"), tmp_path / "out/none.csv") == 0 and (tmp_path / "out/none.csv").stat().st_size == 0
    digest = writers.frozen_candidates(frame, tmp_path / "c.json")
    assert [r["pattern"] for r in json.loads((tmp_path / "c.json").read_text())] == ["a", "b"] and digest in (tmp_path / "c.sha256").read_text()
    digest = writers.provenance({"documents": 2}, tmp_path / "p.json")
    assert json.loads((tmp_path / "p.json").read_text())["self_sha256"] == digest
    (tmp_path / "params.json").write_text(json.dumps(PARAMS.__dict__))
    assert readers.params_json(tmp_path / "params.json") == PARAMS
    study = spark.createDataFrame([("p1", "d1", "news", "gpt4", None, "Text."), ("p1", "d2", "abs", "gpt4", None, "More.")], "partition string, doc_id string, domain string, model string, source_id string, text string")
    writers.study_corpus(study, str(tmp_path / "study"))
    assert {(r.file, r.doc_id) for r in spark.read.parquet(str(tmp_path / "study/documents")).collect()} == {("doc0001.txt", "d2"), ("doc0002.txt", "d1")}


def test_command_line(spark, tmp_path, capsys):
    from lexidrift.__main__ import main

    for name, text in (("ai", "It is not speed, but time."), ("pre", "A red ball."), ("contemporary", "One day.")):
        (tmp_path / name).mkdir()
        for i in range(2):
            (tmp_path / name / f"{i}.txt").write_text(text)
    out = tmp_path / "result.csv"
    assert main(["compare", "--ai", str(tmp_path / "ai"), "--pre", str(tmp_path / "pre"), "--contemporary", str(tmp_path / "contemporary"), "--output", str(out)]) == 0
    assert "not <X> but <Y>" in out.read_text()
    (tmp_path / "r.csv").write_text("id,model,domain,attack,decoding\n1,gpt4,news,none,greedy\n")
    assert main(["survey", str(tmp_path / "r.csv")]) == 0
    assert "field=model  value=gpt4  rows=1" in capsys.readouterr().out


def test_study_commands(spark, tmp_path, capsys):
    import csv

    from lexidrift.__main__ import main

    text = "It was not a storm but a shower, and they had {} of the boats in the harbour. " * 14
    rows = []
    for d in K.CELL_DOMAINS:
        for k in range(2):
            source = f"{K.CELL_DOMAINS.index(d):02d}{k:030d}"
            for m in ("human", *K.DISCOVERY_MODELS, *K.VALIDATION_MODELS):
                body = ("They sailed at noon. The keeper of the light was at home. " * 10) if m == "human" else text.replace("{}", str(k))
                rows.append({"id": f"{source}-{m}", "source_id": source, "model": m, "domain": d, "attack": "none", "decoding": "" if m == "human" else "greedy", "repetition_penalty": "" if m == "human" else "no", "prompt": "Write.", "title": "", "generation": body})
    with (tmp_path / "r.csv").open("w", newline="") as f:
        out = csv.DictWriter(f, fieldnames=list(rows[0]))
        out.writeheader()
        out.writerows(rows)
    (tmp_path / "x.txt").write_text("# none\n")
    (tmp_path / "h.jsonl").write_text(json.dumps({"question": "q", "human_answers": [text], "chatgpt_answers": [text], "source": "s"}) + "\n")
    assert main(["first", str(tmp_path / "r.csv"), str(tmp_path / "h.jsonl"), "--output", str(tmp_path / "first.csv")]) == 0
    found = list(csv.DictReader((tmp_path / "first.csv").open()))
    assert found and [r["candidate_set"] for r in found] == sorted(r["candidate_set"] for r in found)
    assert main(["second", str(tmp_path / "r.csv"), str(tmp_path / "x.txt"), "--output", str(tmp_path / "second"), "--sources-a-phase", "1", "--resamples", "50"]) == 0
    summary = json.loads((tmp_path / "second/summary.json").read_text())
    assert summary["discovery_candidates"] > 0 and summary["lift_matrix_rows"] == summary["discovery_candidates"] * 30 and summary["anchor_sha256"] == I.anchors_sha256()
    assert (tmp_path / "second/lift_matrix.csv").exists() and (tmp_path / "second/candidates.sha256").exists()
    docs = spark.createDataFrame([("news", "s1", "human", "Text.")], "domain string, source_id string, model string, text string")
    assert writers.calibration(docs, 3, str(tmp_path / "calibration"))["by_domain"] == {"news": 1}
    assert (tmp_path / "calibration/exclusions.txt").read_text() == "s1\n"


def test_gate_report(spark):
    from lexidrift.queries import SPREAD

    got = {(r.scenario, r.sources): r.power for r in S.gate_report(spark, PARAMS, SPREAD, 20, 5, (60, 120)).collect()}
    assert len(got) == 9 and got["optimistic", 120] >= got["pessimistic", 120] and got["stress: none", 120] == 0.0
