"""The operators' results in DuckDB SQL, where SQL can express them."""

from __future__ import annotations

WORDS = r"[^\x20\x09-\x0D]+"

ORACLE: dict[str, str] = {
    "op3_substring_dedup": rf"""
        with texts as (
            select doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') as words from documents),
        windows as (
            select doc_id, place, array_to_string(words[place + 1 : place + 20], ' ') as passage
            from (select doc_id, words, unnest(range(len(words) - 19)) as place from texts where len(words) >= 20)),
        later as (
            select doc_id, place from (
                select doc_id, place, min(row(doc_id, place)) over (partition by passage) as earliest from windows)
            where row(doc_id, place) > earliest),
        gone as (select distinct doc_id, place + unnest(range(20)) as position from later),
        words as (
            select doc_id, unnest(words) as word, unnest(range(len(words))) as position from texts),
        kept as (
            select doc_id, count(*) as n_kept, string_agg(word, ' ' order by position) as kept_text
            from words anti join gone using (doc_id, position) group by doc_id)
        select texts.doc_id, cast(len(words) as bigint) as n_words,
               cast(len(words) - coalesce(n_kept, 0) as bigint) as n_removed,
               sha256(coalesce(kept_text, '')) as kept_sha256
        from texts left join kept using (doc_id)
    """,
}

ORACLE["op4_nearest_vectors"] = """
    with rows as (
        select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings
        where vec_id is not null and len(embedding) > 0),
    usable as (
        select vec_id, v, sqrt(list_reduce(list_transform(v, lambda x: x * x), lambda s, x: s + x)) as length
        from (select vec_id, min(v) as v from rows group by vec_id)
        where len(list_filter(v, lambda x: x is null or isnan(x) or isinf(x))) = 0),
    pairs as (
        select q.vec_id as query_id, c.vec_id,
               list_reduce(list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2]), lambda s, x: s + x)
               / (q.length * c.length) as score
        from usable q join usable c on q.vec_id <> c.vec_id and len(q.v) = len(c.v)
        where q.vec_id % 50 = 0 and q.length > 0 and c.length > 0)
    select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank,
           vec_id, score
    from pairs qualify rank <= 5
"""

ORACLE["op5_source_mix"] = rf"""
    with sizes as (
        select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) as bigint) as size,
               md5('mix-1:' || doc_id) as digest from documents),
    totals as (
        select source, sum(size) as source_size,
               list_value(5, 2, 1)[1 + (row_number() over (order by source nulls last) - 1) % 3] as weight
        from sizes group by source),
    levels as (
        select *, 2 * source_size as ceiling,
               (cast(1.5 as double) * sum(source_size) over () - coalesce(sum(2 * source_size) over (
                   order by 2 * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
               / sum(weight) over (
                   order by 2 * source_size / weight, source nulls last rows between current row and unbounded following) as level
        from totals),
    targets as (
        select source, cast(source_size as bigint) as source_size, case when free is null then cast(ceiling as double)
               else least(cast(ceiling as double), free * weight) end as target
        from (select *, max(case when ceiling > level * weight then level end) over () as free from levels)),
    placed as (
        select sizes.*, source_size, target, cast('0x' || substr(digest, 1, 15) as bigint)
               % cast(ceil(greatest(source_size, 1) / 4194304) as bigint) as shard
        from sizes join targets on sizes.source is not distinct from targets.source),
    rings as (
        select source, shard, cast(sum(size) as bigint) as ring, greatest(1, cast(round(sum(size) / 8) as bigint)) as blocks
        from placed group by source, shard having sum(size) > 0),
    quotients as (  -- all of them, so the highest are taken literally
        select source, row_number() over (order by target / (2 * k + 1) desc, source nulls last, k) as place, wanted
        from (select source, target, cast(round(sum(target) over () / 8) as bigint) as wanted,
                     unnest(range(cast(ceil(target / 8) as bigint) + 1000)) as k
              from targets where target > 0)),
    source_seats as (select source, count(*) as total from quotients where place <= wanted group by source),
    shard_quotients as (
        select r.source, r.shard, row_number() over (partition by r.source order by ring / (2 * k + 1) desc, r.shard, k) as place, total
        from (select *, unnest(range(2 * blocks + 1000)) as k from rings) r
        join source_seats s on r.source is not distinct from s.source),
    shard_seats as (
        select source, shard, count(*) as seats from shard_quotients where place <= total group by source, shard),
    runs as (
        select r.*, least(coalesce(seats, 0), 2 * blocks) as seats,
               cast('0x' || substr(md5('mix-1:' || coalesce('s' || r.source, 'n') || ':' || r.shard), 1, 15) as bigint) % blocks as first_block
        from rings r left join shard_seats s on r.source is not distinct from s.source and r.shard = s.shard),
    rounds as (
        select source, shard, ring, seats // blocks as rounds, (seats % blocks) * ring // blocks as run,
               first_block * ring // blocks as start from runs),
    laid as (
        select *, coalesce(sum(size) over (partition by source, shard order by digest, doc_id, size
                                           rows between unbounded preceding and 1 preceding), 0) as at_word from placed)
    select doc_id, l.size, source_size, target, cast(coalesce(rounds * l.size
           + greatest(0, least(at_word + l.size, start + run - ring) - at_word)
           + greatest(0, least(at_word + l.size, least(start + run, ring)) - greatest(at_word, start)), 0) as bigint) as taken
    from laid l left join rounds r on l.source is not distinct from r.source and l.shard = r.shard
"""

# The given conversations hold plain messages only: calls and results are tested on small tables.
ORACLE["op9_chat_messages"] = r"""
    select conv_id, turn, role, turn as anchor, 0 as level, 0 as slot,
           '{"content":' || coalesce(cast(to_json(text) as varchar), 'null') || ',"role":' || coalesce(cast(to_json(role) as varchar), 'null') || '}' as json,
           0 as n_calls, 0 as n_answered, 0 as n_valid, cast(null as varchar) as call_issues, cast(null as varchar) as link
    from conversations
"""
