"""SQL of skeletons, frames, echoes and the second study for a second engine.

That engine composes characters but has no compatibility normalisation, so a table of what
each character becomes by it stands beside the texts.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from lexidrift import sql as S
from lexidrift.functions import constants as K
from lexidrift.operators.cells import SecondStudyRules

_KINDS = (("w", K.WITHIN), ("c", K.CROSS))


@lru_cache(1)
def folds() -> str:
    """Table `folds(c, f)`: characters that compatibility normalisation changes, by the rule itself."""
    pairs = [(c, f) for c in map(chr, range(0x80, sys.maxunicode + 1)) if not 0xD800 <= ord(c) < 0xE000 and (f := unicodedata.normalize("NFKC", c)) != unicodedata.normalize("NFC", c)]
    return f"folds as (select unnest({S._list(c for c, _ in pairs)}) as c, unnest({S._list(f for _, f in pairs)}) as f)"


def skeletons(source: str, keys: str, text: str, name: str = "skel") -> str:
    """Table `<name>(keys, l)`: the skeleton tokens of each text of `source`, whose `keys` are unique."""
    ascii_only = f"regexp_full_match({text}, '[\\x00-\\x7F]*')"
    split = " ".join(f"when {S._s(k)} then {S._list(v)}" for k, v in K.CONTRACTIONS.items())
    return f"""
{name}_chars as (select {keys}, unnest(regexp_extract_all({text}, '(?s).')) as ch, generate_subscripts(regexp_extract_all({text}, '(?s).'), 1) as pos from {source} where not {ascii_only}),
{name}_norm as (
  select {keys}, nfc_normalize(string_agg(coalesce(f, ch), '' order by pos)) as t from {name}_chars left join folds on ch = c group by {keys}
  union all select {keys}, {text} from {source} where {ascii_only}),
{name}_toks as (select {keys}, flatten(list_transform(regexp_extract_all(lower(translate(t, '’‘', '''''')), {S._s(K.STRUCTURAL_TOKEN)}), lambda x: case x {split} else [x] end)) as t from {name}_norm),
{name}_all as (select {keys}, list_transform(t, lambda x: case when x in {S._in(K.PUNCTUATION)} then x when regexp_matches(x, '^\\p{{Nd}}') then '{K.NUMBER_SLOT}' when x in {S._in(K.ANCHORS)} then x else '{K.SLOT}' end) as m from {name}_toks),
{name} as (select {keys}, list_filter(m, lambda x, i: not (x in ('{K.SLOT}', '{K.NUMBER_SLOT}') and i > 1 and x = m[i - 1])) as l from {name}_all)"""


def spans(source: str, keys: str, name: str, boundary: str | None = None) -> str:
    """Table `<name>(keys, pattern)`: qualifying spans of `source(keys, l)`, with `boundary` (a column) those that cross it."""
    crossing = f"and i - 1 < {boundary} and {boundary} < i + n - 1" if boundary else ""
    carried = f", {boundary}" if boundary else ""
    return f"""
{name}_starts as (select {keys}{carried}, l, unnest(range(1, len(l) - {K.MIN_SPAN - 2})) as i from {source}),
{name}_windows as (select {keys}, l[i:i + n - 1] as w from {name}_starts, (select unnest(range({K.MIN_SPAN}, {K.MAX_SPAN + 1})) as n) where i + n - 1 <= len(l) {crossing}),
{name} as (select {keys}, array_to_string(w, ' ') as pattern from {name}_windows
  where len(list_filter(w, lambda t: t in ('{K.SLOT}', '{K.NUMBER_SLOT}'))) between {K.MIN_SLOTS} and {K.MAX_SLOTS} and len(list_filter(w, lambda t: t in {S._in(K.ANCHORS)})) >= {K.MIN_ANCHORS})"""


def skeleton_counts(keys: str) -> str:
    """Table `skeleton_n(keys, kind, pattern, n)` from `sents`."""
    on = " and ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    own = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    return ",".join([
        folds(), skeletons("sents", f"{keys}, para_idx, sent_idx", "sentence"), spans("skel", keys, "within_s"),
        f"""
pairs_s as (select {own}, a.l || b.l as l, len(a.l) as edge from skel a join skel b on {on} and a.para_idx = b.para_idx and b.sent_idx = a.sent_idx + 1 where len(a.l) > 0)""",
        spans("pairs_s", keys, "cross_s", "edge"),
        f"""
skeleton_n as (
  select {keys}, '{K.WITHIN}' as kind, pattern, count(*) as n from within_s group by all
  union all select {keys}, '{K.CROSS}' as kind, pattern, count(*) as n from cross_s group by all)""",
    ])


def exposure(by: str, segs: str = "segs") -> str:
    """Table `seen(by, documents, sentences, adjacent_pairs)`."""
    on = " and ".join(f"d.{k.strip()} = x.{k.strip()}" for k in by.split(","))
    own = ", ".join(f"d.{k.strip()}" for k in by.split(","))
    return f"""
para_n as (select {by}, len(sl) as n from parts),
seen as (select {own}, d.documents, coalesce(x.s, 0)::bigint as sentences, coalesce(x.p, 0)::bigint as adjacent_pairs
  from (select {by}, count(*) as documents from {segs} group by {by}) d left join (select {by}, sum(n) as s, sum(greatest(0, n - 1)) as p from para_n group by {by}) x on {on})"""


def units_of(kind: str, sentences: str, pairs: str) -> str:
    return f"(case when {kind} = '{K.CROSS}' then {pairs} else {sentences} end)"


def ratio(n: str, of: str) -> str:
    return f"coalesce({n}::double / nullif({of}, 0)::double, 0)"


def frame_counts(keys: str) -> str:
    """Table `frame_n(keys, kind, pattern, n)` from `parts`: matches by position, the longest of overlapping ones from the left."""
    kinds = ", ".join(f"({S._s(kind)}, {S._s(template)})" for kind, _, template in K.FRAMES)
    found = " ".join(f"when {S._s(kind)} then regexp_extract_all(unit, {S._s('(?i)' + pattern)})" for kind, pattern, _ in K.FRAMES)
    gaps = " ".join(f"when {S._s(kind)} then string_split_regex(unit, {S._s('(?i)' + pattern)})" for kind, pattern, _ in K.FRAMES)
    return f"""
folded as (select {keys}, para_idx, list_transform(sl, lambda s: translate(s, '’‘', '''''')) as fl from parts),
placed as (select {keys}, para_idx, fl, unnest(range(1, len(fl) + 1)) as i from folded),
units as (
  select {keys}, para_idx, fl[i] as unit, coalesce(list_sum(list_transform(fl[1:i - 1], lambda s: length(s) + 1)), 0)::bigint as off from placed
  union all select {keys}, para_idx, fl[i] || ' ' || fl[i + 1], coalesce(list_sum(list_transform(fl[1:i - 1], lambda s: length(s) + 1)), 0)::bigint from placed where i < len(fl)),
kinds(kind, template) as (values {kinds}),
hits as (select {keys}, para_idx, kind, template, off, case kind {found} end as found, case kind {gaps} end as gaps from units, kinds),
spots as (select *, unnest(range(1, len(found) + 1)) as k from hits where len(found) > 0),
ranges as (select {keys}, para_idx, kind, template, off + list_sum(list_transform(gaps[1:k], lambda g: length(g))) + coalesce(list_sum(list_transform(found[1:k - 1], lambda g: length(g))), 0) as lo, length(found[k]) as size from spots),
lists as (select {keys}, kind, template, para_idx, list([lo, lo + size] order by lo, size desc) as r from ranges group by all),
kept as (select {keys}, kind, template, list_reduce(r, lambda acc, x: case when x[1] >= acc[1] then [x[2], acc[2] + 1] else acc end, [-1, 0]::hugeint[])[2] as n from lists),
frame_n as (select {keys}, kind, template as pattern, sum(n)::bigint as n from kept group by all)"""


def echo_sets() -> str:
    """Table `echoes(source_id, level, pattern)`."""
    source = S.SOURCE.format("source_id")
    strip = S._STRIP.replace("@", "concat_ws(' ', title, prompt)")
    return ",".join([
        f"""
echo_rows as (select {source} as source_id, title, prompt from echo_sources),
echo_src as (select source_id, coalesce(max(nullif(title, '')), '') as title, coalesce(max(nullif(prompt, '')), '') as prompt from echo_rows where source_id is not null group by source_id),
material as (select source_id, {strip} as m from echo_src),
echo_toks as (select source_id, {S.tokens("m")} as t from material)""",
        skeletons("material", "source_id", "m", "echo_skel"), spans("echo_skel", "source_id", "echo_spans"),
        f"""
echoes as (select distinct source_id, 'lexical' as level, unnest({S.grams(every=True)}) as pattern from echo_toks union select distinct source_id, 'structural', pattern from echo_spans)""",
    ])


DOC = "phase, domain, source_id, model, doc_id"


def second_study() -> str:
    """Everything up to `marked(…, kind, pattern, n, echoing)`, `cells` and `seen`, for the small design."""
    return "with " + ",".join([
        S.RECORDS.lstrip(), S.COMPLETE, S.complete(("human",)),
        f"""
ranked as (select *, row_number() over (partition by domain order by sha256(source_id), source_id) as rank, count(*) over (partition by domain) as have
  from complete where source_id not in (select source_id from excl where source_id is not null)),
split as (select domain, source_id, case when rank <= have // 2 then 'discovery' else 'validation' end as phase from ranked where rank <= 2 * (have // 2)),
arms as (select phase, split.domain, rec.source_id, model, max({{'a': coalesce(loaded_at, timestamp '0001-01-01'), 'b': id, 'c': generation}}) as d
  from rec join split on rec.source_id = split.source_id
  where {S.CELLS.replace("source_id", "rec.source_id").replace("domain in", "rec.domain in")} and (model = 'human' or (phase = 'discovery' and model in {S._in(K.DISCOVERY_MODELS)}) or (phase = 'validation' and model in {S._in(K.VALIDATION_MODELS)}))
  group by all),
study2 as (select phase, domain, source_id, model, d.b as doc_id, d.c as text from arms)""",
        S.segments("study2", DOC), S.ngram_rows(DOC), skeleton_counts(DOC), echo_sets(),
        f"""
patterns as (select {DOC}, '{K.NGRAM}' as kind, pattern, n from counts union all select {DOC}, kind, pattern, n from skeleton_n),
marked as (select p.*, case when e.pattern is not null then n else 0 end as echoing from patterns p left join echoes e
  on p.source_id = e.source_id and p.pattern = e.pattern and e.level = (case when kind = '{K.NGRAM}' then 'lexical' else 'structural' end)),
cells as (select phase, domain, model, kind, pattern, sum(n)::bigint as total, sum(n - echoing)::bigint as prim, count(case when n > echoing then 1 end) as documents_with from marked group by all)""",
        exposure("phase, domain, model"),
    ])


def matrix(wanted: str, rules: SecondStudyRules, name: str = "matrix", only: str = "true") -> str:
    units = units_of("kind", "sentences", "adjacent_pairs")
    h_units = units_of("kind", "h_sentences", "h_pairs")
    return f"""
{name}_base as (select phase, domain, documents as h_documents, sentences as h_sentences, adjacent_pairs as h_pairs from seen where model = 'human'),
{name}_models as (select s.*, coalesce(h_sentences, 0) as h_sentences, coalesce(h_pairs, 0) as h_pairs from seen s left join {name}_base h using (phase, domain) where model <> 'human' and {only}),
{name}_filled as (
  select w.kind, w.pattern, m.phase, m.domain, m.model, m.documents, m.sentences, m.adjacent_pairs, m.h_sentences, m.h_pairs, coalesce(c.total, 0) as total, coalesce(c.prim, 0) as prim, coalesce(c.documents_with, 0) as documents_with, coalesce(h.prim, 0) as h_prim
  from (select distinct kind, pattern from {wanted}) w cross join {name}_models m
  left join cells c on c.phase = m.phase and c.domain = m.domain and c.model = m.model and c.kind = w.kind and c.pattern = w.pattern
  left join cells h on h.model = 'human' and h.phase = m.phase and h.domain = m.domain and h.kind = w.kind and h.pattern = w.pattern),
{name}_lift as (select *, ((prim + 0.5::double) / ({units} + 1.0::double)) / ((h_prim + 0.5::double) / ({h_units} + 1.0::double)) as lift, {ratio("documents_with", "documents")} as prevalence from {name}_filled),
{name} as (select *, lift >= {rules.min_lift} and prim >= {rules.min_occurrences} and prevalence >= {rules.min_doc_prevalence} as passes from {name}_lift),
{name}_domains as (select kind, pattern, phase, domain, count(case when passes then 1 end) as passing, min(lift) as least from {name} group by all),
{name}_q as (select kind, pattern, phase, count(case when passing >= {rules.min_passing_models} and least >= {rules.no_reversal_lift} then 1 end) as domains from {name}_domains group by all)"""


def candidates(rules: SecondStudyRules) -> str:
    return ",".join([
        f"""
universe as (select distinct kind, pattern from cells c join seen s using (phase, domain, model) where phase = 'discovery' and model <> 'human' and prim >= {rules.min_occurrences} and {ratio("documents_with", "documents")} >= {rules.min_doc_prevalence})""",
        matrix("universe", rules, "first", "phase = 'discovery'"),
        f"""
candidates as (select kind, pattern, domains from first_q where phase = 'discovery' and domains >= {rules.min_domains})""",
    ])


def replicated(rules: SecondStudyRules) -> str:
    return matrix("candidates", rules, "second") + f""",
sides as (select kind, pattern, coalesce(max(case when phase = 'discovery' then domains end), 0) as discovery_domains, coalesce(max(case when phase = 'validation' then domains end), 0) as validation_domains from second_q group by all),
verdicts as (select *, discovery_domains >= {rules.min_domains} and validation_domains >= {rules.min_domains} as replicated from sides)"""


def rounded(value: str, places: int) -> str:
    return f"round(({value})::decimal(38, 12), {places})::double"


def wide_kinds(corpora: tuple[str, ...], column: str) -> str:
    """Table `wide(kind, pattern, …)` of n-grams and frames from `counts` and `frame_n`."""
    parts = ", ".join(f"coalesce(sum(case when {column} = '{c}' then {v} end), 0)::bigint as {c}_{n}" for c in corpora for v, n in (("occ", "occurrences"), ("docs_with", "documents_with")))
    return f"""
every as (
  select {column}, '{K.NGRAM}' as kind, pattern, sum(n) as occ, count(*) as docs_with from counts group by all
  union all select {column}, kind, pattern, sum(n), count(*) from frame_n group by all),
wide as (select kind, pattern, {parts} from every group by kind, pattern)"""


def report(three: str) -> str:
    """The ranked comparison as published."""
    corpora = ("ai", "pre", "contemporary")
    return three + "," + ",".join([S.ngram_rows(), frame_counts("corpus, doc_id"), wide_kinds(corpora, "corpus"), S.sizes(corpora, "corpus", "docs")]) + f"""
        select kind as pattern_kind, pattern, ai_occurrences, ai_documents_with, {rounded(S.per_10k("ai"), 4)} as ai_rate_per_10k_sentences, {rounded(ratio("ai_documents_with", "ai_documents"), 6)} as ai_document_prevalence,
               pre_occurrences as pre_human_occurrences, {rounded(S.per_10k("pre"), 4)} as pre_human_rate_per_10k_sentences,
               contemporary_occurrences as contemporary_human_occurrences, {rounded(S.per_10k("contemporary"), 4)} as contemporary_human_rate_per_10k_sentences,
               {rounded(S.lift("ai", "pre"), 4)} as lift_vs_pre_human_smoothed, {rounded(S.lift("ai", "contemporary"), 4)} as lift_vs_contemporary_human_smoothed
        from wide, dsize, ssize where ai_documents_with >= 2 and ai_occurrences >= 2"""


def first_study(study: str) -> str:
    """The candidates of the first study with their verdicts, frames among them: table `judged`."""
    parts = {"ai_discovery": "discovery", "ai_validation": "validation", "human_baseline": "human", "hc3_ai": "hc3_ai", "hc3_human": "hc3_human"}
    prevalence = ratio("ai_discovery_documents_with", "ai_discovery_documents")
    columns = ", ".join(
        f"{p}_occurrences as {s}_occurrences, {p}_documents_with as {s}_documents_with, {rounded(ratio(f'{p}_documents_with', f'{p}_documents'), 4)} as {s}_doc_prevalence, {rounded(S.per_10k(p), 3)} as {s}_per_10k_sentences"
        for p, s in parts.items()
    )
    lifts = ", ".join(f"{rounded(S.lift(a, b), 4)} as lift_{name}" for name, a, b in (("discovery_vs_human", "ai_discovery", "human_baseline"), ("validation_vs_human", "ai_validation", "human_baseline"), ("hc3_ai_vs_hc3_human", "hc3_ai", "hc3_human")))
    return study + "," + ",".join([S.segments("study", "part, doc_id"), S.ngram_rows("part, doc_id"), frame_counts("part, doc_id"), wide_kinds(tuple(parts), "part"), S.sizes(tuple(parts), "part", "study")]) + f""",
sized as (select * from wide, dsize, ssize),
top as (select *, case when {prevalence} >= 0.25 then 'preregistered' else 'exploratory' end as candidate_set from sized
  where kind = '{K.NGRAM}' and ai_discovery_occurrences >= 5 and {prevalence} >= 0.05 order by {prevalence} desc, ai_discovery_occurrences desc, pattern limit 300),
named as (select * from top union all select *, 'structural' from sized where kind <> '{K.NGRAM}' and ai_discovery_occurrences > 0),
rates as (select kind as pattern_kind, pattern, candidate_set, {columns}, {lifts} from named),
tested as (select *, lift_discovery_vs_human >= 1.5 as elevated_in_discovery, lift_validation_vs_human >= 1.5 and validation_doc_prevalence >= 0.10 and validation_occurrences >= 5 as replicated from rates),
judged as (select *, case when replicated then 'REPLICATED' when elevated_in_discovery then 'FAILED_VALIDATION' else 'NOT_ELEVATED' end as verdict from tested)"""


def cluster_params() -> str:
    """Medians and quartiles by nearest rank of rates and dispersions of the skeletons common in human documents."""
    keys = "doc_id, model"
    ranks = ", ".join(f"v_{c}[least(floor((len(v_{c}) - 1) * {q} + 0.5)::int, len(v_{c}) - 1) + 1] as {name}_{tag}" for c, name in (("rate", "base_rate_per_unit"), ("phi", "source_dispersion"), ("model_phi", "model_dispersion")) for tag, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)))
    return "with " + ",".join([
        S.RECORDS.lstrip(), f"""
human_rows as (select id as doc_id, model, generation as text from rec where {S.CELLS})""",
        S.segments("human_rows", keys), skeleton_counts(keys), f"""
doc_sents as (select {keys}, sum(len(sl)) as sentences from parts group by all),
sizes as (select s.doc_id, s.model, coalesce(d.sentences, 0) as sentences from segs s left join doc_sents d using (doc_id, model)),
h as (select count(*)::double as h_docs, sum(sentences)::double as h_units from sizes where model = 'human'),
common_s as (select kind, pattern, count(*) as docs, sum(n)::double as total, sum(n * n)::double as squares from skeleton_n where model = 'human' group by all),
common as (select kind, pattern, total / h_units as rate, case when h_docs >= 3 and total > 0 then greatest(0.0::double, ((squares - total * (total / h_docs)) / (h_docs - 1) - total / h_docs) / ((total / h_docs) * (total / h_docs))) end as phi from common_s, h where docs / h_docs >= 0.10),
arms as (select model, sum(sentences)::double as units from sizes where model <> 'human' group by model having sum(sentences) > 0),
uses as (select kind, pattern, model, sum(n) as n from skeleton_n group by all),
per_model as (select c.kind, c.pattern, coalesce(u.n, 0) / a.units as r from common c cross join arms a left join uses u on u.kind = c.kind and u.pattern = c.pattern and u.model = a.model),
spread as (select kind, pattern, var_samp(r) / (avg(r) * avg(r)) as model_phi from per_model group by all having count(*) >= 3 and avg(r) > 0),
joined as (select c.*, s.model_phi from common c left join spread s using (kind, pattern)),
lists as (select count(*) as skeletons, list(rate order by rate) filter (rate is not null) as v_rate, list(phi order by phi) filter (phi is not null) as v_phi, list(model_phi order by model_phi) filter (model_phi is not null) as v_model_phi from joined)
select skeletons, h_units / h_docs as exposure_per_doc, {ranks} from lists, h""",
    ])


def oracle_sql(small: SecondStudyRules) -> dict[str, str]:
    three = "with " + ",".join([S.RECORDS.lstrip(), S.ANSWERS, S.THREE, S.segments()])
    keys = "corpus, doc_id"
    skeleton = three + "," + skeleton_counts(keys)
    rates = skeleton + "," + exposure("corpus") + f""",
rates as (
  select corpus, kind, pattern, sum(n)::bigint as occurrences, count(*) as documents_with,
         {ratio("sum(n)", units_of("kind", "any_value(sentences)", "any_value(adjacent_pairs)"))} * 10000 as per_10k, {ratio("sum(n)", "(any_value(sentences) + any_value(adjacent_pairs))")} * 10000 as combined_per_10k, {ratio("count(*)", "any_value(documents)")} as doc_prevalence
  from skeleton_n join seen using (corpus) group by corpus, kind, pattern)"""
    echo = "with " + ",".join([folds(), echo_sets().lstrip()])
    study = second_study()
    found = study + "," + candidates(small)
    echoing = """sum(n)::bigint as total, sum(echoing)::bigint as echoing, (sum(n) - sum(echoing))::bigint as "primary", """ + f"{ratio('sum(echoing)', 'sum(n)')} as echo_fraction, {ratio('sum(echoing)', 'sum(n)')} > {K.PROMPT_DERIVED_ABOVE} as prompt_derived"
    frames = three + "," + frame_counts(keys)
    judged = first_study("with " + ",".join([S.RECORDS.lstrip(), S.ANSWERS, S.STUDY]))
    return {
        "pattern_report": report(three),
        "study_verdicts": judged + " select * from judged",
        "study_verdict_counts": judged + " select candidate_set, verdict, count(*) as candidates from judged group by candidate_set, verdict",
        "cluster_params": cluster_params(),
        "skeleton_tokens": three + "," + ",".join([folds(), skeletons("sents", f"{keys}, para_idx, sent_idx", "sentence")]) + f" select {keys}, para_idx, sent_idx, array_to_string(l, ' ') as skeleton from skel",
        "skeleton_rates": rates + " select * from rates",
        "skeleton_types": rates + " select corpus, kind, count(*) as types, sum(occurrences)::bigint as occurrences from rates group by corpus, kind",
        "skeleton_top": rates + " select * from (select *, row_number() over (partition by corpus, kind order by occurrences desc, pattern) as rank from rates) where rank <= 50",
        "frame_counts": frames + " select corpus, kind, pattern, sum(n)::bigint as occurrences, count(*) as documents_with from frame_n group by all",
        "echo_sets": echo + " select source_id, level, pattern from echoes",
        "echo_diagnostics": study + f" select phase, kind, {echoing} from marked group by phase, kind",
        "echo_patterns": study + f" select kind, pattern, {echoing} from marked group by kind, pattern",
        "cell_counts": study + ' select phase, domain, model, kind, pattern, total, prim as "primary", documents_with from cells',
        "cell_candidates": found + " select kind, pattern, domains from candidates",
        "cell_candidate_kinds": found + " select kind, count(*) as candidates from candidates group by kind",
        "cell_replication": found + "," + replicated(small) + " select kind, pattern, discovery_domains, validation_domains, replicated from verdicts",
    }
