"""SQL of the queries that a second engine can express."""

from __future__ import annotations

from lexidrift.llm.keys import PLACEHOLDERS
from lexidrift.llm.repetition import LENGTHS, MIN_SHARE
from lexidrift.llm.sampling import HEX_DIGITS, SALT


def canonical(value: str) -> str:
    bare = f"regexp_replace(regexp_replace(lower({value}), '^[^a-z0-9]*urn:[a-z0-9]+:', ''), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
    return f"(case when {bare} in ('', {', '.join(repr(p) for p in PLACEHOLDERS)}) or regexp_full_match({bare}, '0+') then null else {bare} end)"


def sample(rate: float, key: str) -> str:
    return f"""
        with keyed as (select id, source_id, loaded_at, {key} as sample_key from raid_train where id is not null),
        drawn as (select *, ('0x' || substr(md5('{SALT}|' || sample_key), 1, {HEX_DIGITS}))::bigint / {float(16**HEX_DIGITS)!r}::double as u from keyed),
        ranked as (select *, row_number() over (partition by id order by loaded_at nulls last, source_id nulls last, sample_key, u) as n from drawn where u < {rate})
        select id, source_id, sample_key, u from ranked where n = 1"""


def oracle_sql() -> dict[str, str]:
    families = f"""
        with recursive raw as (select id, {canonical("id")} as a, {canonical("source_id")} as b, source_id from raid_train),
        denoted as (select distinct b from raw where b is not null),
        pairs as (select distinct a, b from raw where id is not null and a is not null and b is not null and a <> b and a in (select b from denoted)),
        carried as (select distinct id, b from raw where id is not null and b is not null),
        shared as (select distinct p.b as a, q.b as b from carried p join carried q on p.id = q.id and p.b <> q.b),
        every as (select a, b from pairs union select a, b from shared),
        links as (select a as x, b as y from every union select b, a from every),
        reach as (select distinct x as n, x as m from links union select r.n, l.y from reach r join links l on l.x = r.m),
        roots as (select n, min(m) as root from reach group by n),
        family as (select distinct source_id, coalesce(root, b) as f from raw left join roots on n = b where b is not null)"""
    pairs = families + """
        select p.source_id as source_id_1, q.source_id as source_id_2 from family p join family q on p.f = q.f and p.source_id < q.source_id"""
    own = canonical("id")
    n = LENGTHS[0]
    repetitive = f"""
        with letters as (select id, regexp_replace(lower(any_value(generation)), '[^\\p{{L}}\\p{{N}}]', '', 'g') as s from raid_train group by id),
        starts as (select id, s, unnest(range(1, length(s) - {n} + 2)) as i from letters where length(s) > {n}),
        windows as (select id, i, min(i) over (partition by id, substr(s, i, {n})) as first from starts),
        later as (select id, i, lead(i) over (partition by id order by i) as next from windows where i > first),
        covered as (select id, sum(least({n}, coalesce(next - i, {n}))) as c from later group by id)
        select id from covered join letters using (id) where c >= {MIN_SHARE} * length(s)"""
    return {
        "p2_found": repetitive,
        "p1_found": pairs,
        "p1_families": families + " select source_id, f as family from family",
        "p5_sample_by_id": sample(0.1, f"coalesce({own}, id)"),
        "p5_sample_by_source": sample(0.1, f"coalesce({canonical('source_id')}, {own}, id)"),
    }
