"""SQL of the core queries for a second engine over the same tables."""

from __future__ import annotations

from lexidrift.functions import constants as K


def _s(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(map(_s, values)) + "]"


def _in(values) -> str:
    return "(" + ", ".join(map(_s, values)) + ")"


_WS = K.SPACE
_COLLAPSE = "trim(regexp_replace(@, " + _s(_WS + "+") + ", ' ', 'g'))"
_STRIP = "regexp_replace(regexp_replace(@, " + _s("^" + _WS + "+") + ", ''), " + _s(_WS + "+$") + ", '')"
#: The boundary without a look-behind: the mark goes between what is kept on either side.
_BOUNDARY = "([.!?])[\"'”’)]*" + _WS + "+([A-Z0-9\"'“‘(])"

TIDY = "nullif(regexp_replace(lower(trim({0})), '[ _]+', '-', 'g'), '')"
SOURCE = "(case when length(regexp_replace(lower({0}), 'urn:uuid:|[^0-9a-f]', '', 'g')) = 32 then regexp_replace(lower({0}), 'urn:uuid:|[^0-9a-f]', '', 'g') end)"

RECORDS = f"""
rec as (
  select id, {SOURCE.format("any_value(source_id)")} as source_id, {TIDY.format("any_value(model)")} as model, {TIDY.format("any_value(domain)")} as domain,
         any_value(attack) as attack, any_value(decoding) as decoding, any_value(repetition_penalty) as repetition_penalty, any_value(generation) as generation, max(loaded_at) as loaded_at
  from raid_train where id is not null group by id)"""

ANSWERS = """
hc3 as (select q_id, any_value(source) as source, any_value(human_answers) as h, any_value(chatgpt_answers) as c from hc3_answers where q_id is not null group by q_id),
ans as (
  select q_id, source, 'human' as side, generate_subscripts(h, 1) - 1 as answer_no, unnest(h) as text from hc3
  union all
  select q_id, source, 'chatgpt' as side, generate_subscripts(c, 1) - 1 as answer_no, unnest(c) as text from hc3),
answers as (select * from ans where text is not null)"""

THREE = f"""
docs as (
  select 'ai' as corpus, id as doc_id, generation as text from rec where model in {_in(K.DISCOVERY_MODELS)}
  union all select 'pre', id, generation from rec where model = 'human'
  union all select 'contemporary', concat_ws(':', q_id, answer_no), text from answers where side = 'human')"""


def segments(source: str = "docs", keys: str = "corpus, doc_id") -> str:
    """Tables `segs` (one row a document with its paragraphs), `sents` (one row a sentence) and `toks`."""
    return f"""
segs as (select {keys}, list_filter(list_transform(string_split_regex(coalesce(text, ''), {_s(chr(92) + "n" + _WS + "*" + chr(92) + "n+")}), lambda p: {_COLLAPSE.replace("@", "p")}), lambda p: p <> '') as paras from {source}),
para as (select {keys}, generate_subscripts(paras, 1) - 1 as para_idx, unnest(paras) as p from segs),
parts as (select {keys}, para_idx, list_filter(list_transform(string_split(regexp_replace(p, {_s(_BOUNDARY)}, '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '') as sl from para),
sents as (select {keys}, para_idx, generate_subscripts(sl, 1) - 1 as sent_idx, unnest(sl) as sentence from parts)"""


def tokens(text: str) -> str:
    return f"regexp_extract_all(lower(translate({text}, '’‘', '''''')), {_s(K.TOKEN)})"


def grams(every: bool = False) -> str:
    lists = " || ".join(f"list_transform(range(1, len(t) - {n} + 2), lambda i: t[i:i + {n - 1}])" for n in range(K.MIN_N, K.MAX_N + 1))
    if every:
        return f"list_transform({lists}, lambda g: array_to_string(g, ' '))"
    keep = f"len(list_filter(g, lambda x: not list_contains({_list(K.FUNCTION_WORDS)}, x))) > 0 and len(list_filter(g, lambda x: not regexp_full_match(x, '\\p{{Nd}}+'))) > 0"
    return f"list_transform(list_filter({lists}, lambda g: {keep}), lambda g: array_to_string(g, ' '))"


def ngram_rows(keys: str = "corpus, doc_id") -> str:
    return f"""
toks as (select {keys}, {tokens("sentence")} as t from sents),
flat as (select {keys}, unnest({grams()}) as pattern from toks),
counts as (select {keys}, pattern, count(*) as n from flat group by {keys}, pattern)"""


def long_enough(text: str) -> str:
    return f"length({_STRIP.replace('@', f'coalesce({text}, {chr(39) * 2})')}) >= {K.MIN_CHARS}"


PROSE = f"attack = 'none' and domain in {_in(K.PROSE_DOMAINS)} and {long_enough('generation')}"
CELLS = f"attack = 'none' and domain in {_in(K.CELL_DOMAINS)} and (model = 'human' or (decoding = 'greedy' and repetition_penalty = 'no')) and source_id is not null and {long_enough('generation')}"

STUDY = f"""
drawn as (
  select * from (
    select *, row_number() over (partition by part, domain, model order by sha256(id), id) as rank
    from (select *, case when model in {_in(K.DISCOVERY_MODELS)} then 'ai_discovery' when model in {_in(K.VALIDATION_MODELS)} then 'ai_validation' end as part from rec where {PROSE})
    where part is not null) where rank <= {K.DOCS_PER_STRATUM}),
wanted as (select distinct domain, source_id as w from drawn where source_id is not null),
humans as (
  select * from (
    select *, row_number() over (partition by domain order by sha256(id), id) as rank
    from rec r where {PROSE} and model = 'human' and exists (select 1 from wanted x where x.domain = r.domain and (x.w = r.source_id or x.w = {SOURCE.format("r.id")})))
  where rank <= {K.HUMAN_PER_DOMAIN}),
short as (
  select * from (
    select *, row_number() over (partition by source, side order by sha256(key), key) as rank
    from (select *, concat_ws(':', q_id, side, answer_no) as key from answers where source is not null and {long_enough('text')}))
  where rank <= {K.HC3_PER_STRATUM}),
study as (
  select part, id as doc_id, domain, model, source_id, generation as text from drawn
  union all select 'human_baseline', id, domain, model, source_id, generation from humans
  union all select case side when 'human' then 'hc3_human' else 'hc3_ai' end, key, source, side, null, text from short)"""

COMPLETE = f"""
excl as (select distinct {SOURCE.format("source_id")} as source_id from calibration_sources)"""


def complete(models) -> str:
    every = ("human", *K.DISCOVERY_MODELS, *K.VALIDATION_MODELS)
    return f"complete as (select max_by(domain, id) as domain, source_id from rec where {CELLS} and model in {_in(every)} group by source_id having count(distinct case when model in {_in(models)} then model end) = {len(set(models))})"


def wide(corpora, column: str) -> str:
    parts = ", ".join(f"coalesce(sum(case when {column} = '{c}' then {v} end), 0)::bigint as {c}_{n}" for c in corpora for v, n in (("occ", "occurrences"), ("docs_with", "documents_with")))
    return f"wide as (select pattern, {parts} from (select {column}, pattern, sum(n) as occ, count(*) as docs_with from counts group by {column}, pattern) group by pattern)"


def sizes(corpora, column: str, table: str) -> str:
    d = ", ".join(f"count(case when {column} = '{c}' then 1 end) as {c}_documents" for c in corpora)
    s = ", ".join(f"count(case when {column} = '{c}' then 1 end) as {c}_sentences" for c in corpora)
    return f"dsize as (select {d} from {table}), ssize as (select {s} from sents)"


def lift(a: str, b: str) -> str:
    return f"(({a}_occurrences + 0.5::double) / ({a}_sentences + 1.0::double)) / (({b}_occurrences + 0.5::double) / ({b}_sentences + 1.0::double))"


def per_10k(c: str) -> str:
    return f"coalesce({c}_occurrences::double / nullif({c}_sentences, 0)::double, 0) * 10000"


def oracle_sql() -> dict[str, str]:
    three = "with " + ",".join([RECORDS.lstrip(), ANSWERS, THREE, segments()])
    five = ("ai_discovery", "ai_validation", "human_baseline", "hc3_ai", "hc3_human")
    study = "with " + ",".join([RECORDS.lstrip(), ANSWERS, STUDY])
    study_counts = study + "," + ",".join([segments("study", "part, doc_id"), ngram_rows("part, doc_id"), wide(five, "part"), sizes(five, "part", "study")])
    prevalence = "(ai_discovery_documents_with::double / nullif(ai_discovery_documents, 0)::double)"
    nominated = f"""named as (
      select *, case when {prevalence} >= 0.25 then 'preregistered' else 'exploratory' end as candidate_set
      from wide, dsize, ssize where ai_discovery_occurrences >= 5 and {prevalence} >= 0.05
      order by {prevalence} desc, ai_discovery_occurrences desc, pattern limit 300)"""
    out = {
        "doc_exposure": three + """
            select s.corpus, count(*) as documents, sum(len(paras))::bigint as paragraphs, sum(coalesce(x.s, 0))::bigint as sentences, sum(coalesce(x.pairs, 0))::bigint as adjacent_pairs, sum(coalesce(x.t, 0))::bigint as tokens
            from segs s left join (
              select corpus, doc_id, sum(n) as s, sum(greatest(0, n - 1)) as pairs, sum(tk) as t from (
                select corpus, doc_id, para_idx, count(*) as n, sum(len(""" + tokens("sentence") + """)) as tk from sents group by all) group by all) x using (corpus, doc_id)
            group by s.corpus""",
        "sentence_units": three + " select corpus, doc_id, para_idx, sent_idx, sentence from sents",
        "adjacent_pairs": three + """ select * from (select corpus, doc_id, para_idx, sent_idx, sentence as first, lead(sentence) over (partition by corpus, doc_id, para_idx order by sent_idx) as second from sents) where second is not null""",
        "token_counts": three + f", tk as (select corpus, doc_id, unnest({tokens('sentence')}) as token from sents) select corpus, token, count(*) as occurrences, count(distinct doc_id) as documents_with from tk group by corpus, token",
        "document_ngrams": three + "," + ngram_rows() + " select corpus, pattern, sum(n)::bigint as occurrences, count(*) as documents_with from counts group by corpus, pattern",
        "ngram_counts": three + "," + ngram_rows() + " select corpus, pattern, sum(n)::bigint as occurrences, count(*) as documents_with from counts group by corpus, pattern",
        "pattern_lift_3way": three + "," + ",".join([ngram_rows(), wide(("ai", "pre", "contemporary"), "corpus"), sizes(("ai", "pre", "contemporary"), "corpus", "docs")]) + f"""
            select 'ngram' as pattern_kind, pattern, ai_occurrences, ai_documents_with, {per_10k("ai")} as ai_rate_per_10k_sentences,
                   coalesce(ai_documents_with::double / nullif(ai_documents, 0)::double, 0) as ai_document_prevalence,
                   pre_occurrences as pre_human_occurrences, {per_10k("pre")} as pre_human_rate_per_10k_sentences,
                   contemporary_occurrences as contemporary_human_occurrences, {per_10k("contemporary")} as contemporary_human_rate_per_10k_sentences,
                   {lift("ai", "pre")} as lift_vs_pre_human_smoothed, {lift("ai", "contemporary")} as lift_vs_contemporary_human_smoothed
            from wide, dsize, ssize where ai_documents_with >= 2 and ai_occurrences >= 2""",
        "strata_survey": "with " + RECORDS.lstrip() + """
            select 'model' as field, model as value, count(*) as rows from rec group by model
            union all select 'domain', domain, count(*) from rec group by domain
            union all select 'attack', attack, count(*) from rec group by attack
            union all select 'decoding', decoding, count(*) from rec group by decoding
            union all select 'all', null, count(*) from rec
            union all select 'model/domain', concat_ws('/', coalesce(model, ''), coalesce(domain, '')), count(*) from rec where attack = 'none' group by 2""",
        "sampled_models": study + " select part as partition, domain, model, rank, id from drawn",
        "matched_humans": study + " select domain, rank, id from humans",
        "sampled_answers": study + " select source, side, rank, key from short",
        "study_partitions": study + " select part as partition, count(*) as documents, array_to_string(list_sort(list(distinct model)), ',') as models, array_to_string(list_sort(list(distinct domain)), ',') as domains from study group by part",
        "complete_sources": "with " + ",".join([RECORDS.lstrip(), COMPLETE, complete(("human", "chatgpt"))]) + " select domain, source_id from complete",
        "calibration_exclusion": "with " + ",".join([RECORDS.lstrip(), COMPLETE, complete(("human",))]) + " select domain, source_id from complete where source_id not in (select source_id from excl where source_id is not null)",
        "calibration_rows": "with " + ",".join([RECORDS.lstrip(), COMPLETE]) + f" select domain, source_id, model, id from rec where {CELLS} and source_id in (select source_id from excl where source_id is not null)",
        "phase_split": "with " + ",".join([RECORDS.lstrip(), COMPLETE, complete(("human",))]) + """
            select domain, source_id, case when rank <= have // 2 then 'discovery' else 'validation' end as phase from (
              select *, row_number() over (partition by domain order by sha256(source_id), source_id) as rank, count(*) over (partition by domain) as have
              from complete where source_id not in (select source_id from excl where source_id is not null))
            where rank <= 2 * (have // 2)""",
        "echo_sets_lexical": f"""
            with es as (select {SOURCE.format("source_id")} as source_id, title, prompt from echo_sources),
            src as (select source_id, coalesce(max(nullif(title, '')), '') as title, coalesce(max(nullif(prompt, '')), '') as prompt from es where source_id is not null group by source_id),
            m as (select source_id, {tokens("concat_ws(' ', title, prompt)")} as t from src)
            select distinct source_id, 'lexical' as level, unnest({grams(every=True)}) as pattern from m""",
        "study_nomination_lexical": study_counts + "," + nominated + " select pattern, ai_discovery_occurrences, ai_discovery_documents_with, candidate_set from named",
        "study_verdicts_lexical": study_counts + "," + nominated + f""",
            lifted as (select *, round({lift("ai_discovery", "human_baseline")}, 4) as ld, round({lift("ai_validation", "human_baseline")}, 4) as lv, round(coalesce(ai_validation_documents_with::double / nullif(ai_validation_documents, 0)::double, 0), 4) as pv from named)
            select pattern, candidate_set, ai_discovery_occurrences as discovery_occurrences, ai_validation_occurrences as validation_occurrences, human_baseline_occurrences as human_occurrences, hc3_ai_occurrences, hc3_human_occurrences,
                   ld >= 1.5 as elevated_in_discovery, (lv >= 1.5 and pv >= 0.10 and ai_validation_occurrences >= 5) as replicated,
                   case when lv >= 1.5 and pv >= 0.10 and ai_validation_occurrences >= 5 then 'REPLICATED' when ld >= 1.5 then 'FAILED_VALIDATION' else 'NOT_ELEVATED' end as verdict
            from lifted""",
        "content_hashes": study + """,
            canon as (select part, doc_id, regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '\\n+$', '') as bare from study)
            select part as partition, doc_id, sha256(case when bare = '' then '' else bare || chr(10) end) as sha256 from canon""",
        "content_digest": study + """,
            canon as (select regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '\\n+$', '') as bare from study),
            h as (select sha256(case when bare = '' then '' else bare || chr(10) end) as x from canon where bare is not null)
            select count(*) as documents, sha256(string_agg(x, chr(10) order by x) || chr(10)) as digest from h""",
        "word_dispersion": three + f""", tk as (select corpus, doc_id, unnest({tokens('sentence')}) as token from sents),
            per as (select corpus, doc_id, token, count(*) as n from tk group by all),
            d as (select corpus, count(*)::double as docs from docs group by corpus),
            s as (select corpus, token, sum(n)::double as total, sum(n * n)::double as squares from per group by all)
            select s.corpus, token, case when docs >= 3 and total > 0 then greatest(0.0::double, ((squares - total * (total / docs)) / (docs - 1) - total / docs) / ((total / docs) * (total / docs))) end as dispersion from s join d using (corpus)""",
        "sentence_quartiles": three + """, n as (select s.corpus, s.doc_id, sum(len(p.sl)) as k from segs s left join parts p using (corpus, doc_id) group by all),
            l as (select corpus, list_sort(list(coalesce(k, 0)::bigint)) as v from n group by corpus)
            select corpus, v[least(floor((len(v) - 1) * 0.25 + 0.5)::int, len(v) - 1) + 1] as q1, v[least(floor((len(v) - 1) * 0.5 + 0.5)::int, len(v) - 1) + 1] as median, v[least(floor((len(v) - 1) * 0.75 + 0.5)::int, len(v) - 1) + 1] as q3 from l""",
    }
    from lexidrift import sql_patterns
    from lexidrift.plans.studies import SMALL_RULES

    return out | sql_patterns.oracle_sql(SMALL_RULES)
