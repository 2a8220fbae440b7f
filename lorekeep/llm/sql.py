"""DuckDB SQL for the queries that SQL can express."""

SOURCE_MIX = r"""
with sized as (
    select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
           substr(md5(concat('7:', coalesce(doc_id::varchar, ':' || coalesce(text, '')))), 1, 6) as cell
    from documents
), totals as (
    select source, sum(size)::bigint as source_size from sized group by source
), weighted as (
    select *, [3, 1, 2][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight from totals
), ranked as (
    -- a source is clamped before another if its size is smaller against its weight
    select *, row_number() over (order by source_size / weight, source) as place from weighted
), levels as (
    select place, source_size, weight,
           (1.5 * sum(source_size) over ()
            - coalesce(sum(2 * source_size) over (order by place rows between unbounded preceding and 1 preceding), 0))
           / sum(weight) over (order by place rows between current row and unbounded following) as level
    from ranked
), chosen as (
    select level, place from levels where weight * level <= 2 * source_size order by place limit 1
), targets as (
    select source, source_size,
           case when r.place < c.place then 2.0 * source_size else weight * c.level end::double as target
    from ranked r, chosen c
), plans as (
    select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as whole from targets
), needs as (
    select *, target - whole * source_size as need from plans
), cells as (
    select s.source, s.cell, sum(s.size) as cell_size from sized s group by s.source, s.cell
), running as (
    select c.*, n.need, sum(cell_size) over (partition by c.source order by cell) as after_cell
    from cells c join needs n on c.source is not distinct from n.source
), limits as (
    select source, cell as limit_cell, after_cell - need <= need - (after_cell - cell_size) as inside
    from running where after_cell - cell_size < need and need <= after_cell
)
select s.doc_id, s.size::bigint as size, n.source_size, n.target,
       (s.size * (n.whole + case when s.cell < l.limit_cell or (s.cell = l.limit_cell and l.inside) then 1 else 0 end)
       )::bigint as taken
from sized s
join needs n on s.source is not distinct from n.source
left join limits l on s.source is not distinct from l.source
"""

EXACT_DUPLICATES = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept,
       sha256(coalesce(text, '')) as text_sha256
from documents
window w as (partition by coalesce(text, ''))
"""

NEAR_DUPLICATES = r"""
with recursive cut as (
    select doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') as w
    from documents
), sets as (
    select doc_id, case
        when len(w) = 0 then []::varchar[]
        when len(w) < 4 then [array_to_string(w, ' ')]
        else list_distinct([array_to_string(w[i : i + 3], ' ') for i in range(1, len(w) - 2)]) end as s
    from cut
), sized as (
    select doc_id, s, len(s) as n from sets
), distinct_sets as (
    select min(doc_id) as rep, s, n from (select doc_id, list_sort(s) as s, n from sized where n > 0) group by s, n
), items as (
    select rep, n, unnest(s) as item from distinct_sets
), pairs as (
    select a.rep as x, b.rep as y, a.n as nx, b.n as ny, count(*) as both_n
    from items a join items b on a.item = b.item and a.rep < b.rep
    group by all
), links as (
    select x, y from pairs where 100 * both_n >= 80 * (nx + ny - both_n)
), edges as (
    select x as a, y as b from links union all select y, x from links
), reach(a, b) as (
    select rep, rep from distinct_sets
    union
    select r.a, e.b from reach r join edges e on r.b = e.a
), components as (
    select a as rep, min(b) as component_id from reach group by a
), classes as (
    select z.doc_id, d.rep from sized z join distinct_sets d on list_sort(z.s) = d.s and z.n = d.n
)
select z.doc_id, z.n::bigint as n_shingles, coalesce(c.component_id, z.doc_id) as component_id,
       z.doc_id = coalesce(c.component_id, z.doc_id) as kept
from sized z
left join classes k on k.doc_id = z.doc_id
left join components c on c.rep = k.rep
"""

SPELLING = r"""
with recursive table256 as (
    select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
        lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end)) as t
), runs as (
    select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[a-z\x{C0}-\x{FF}]{7,}')) as run
    from documents
), per_document as (
    select id, run, count(*) as n, hex(encode(id || ':' || run)) as h from runs group by id, run
), coded as (
    select run, n, xor(4294967295::bigint, list_reduce(
        list_prepend(4294967295::bigint, list_transform(range(1, len(h), 2), lambda i: ('0x' || substr(h, i, 2))::bigint)),
        lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) as code
    from per_document, table256
), slipped as (
    select n, case when code % 31 = 0
        then left(run, (code % length(run))::int) || substr(run, (code % length(run))::int + 2) else run end as word
    from coded
), words as (
    select word, sum(n)::bigint as n from slipped where length(word) >= 7 group by word having sum(n) >= 2
), cuts as (
    select distinct word, n, unnest(list_transform(range(1, length(word) + 1), lambda i: struct_pack(
        at := i, rest := left(word, (i - 1)::int) || substr(word, (i + 1)::int)))) as cut
    from words
), pairs as (
    select a.word, b.word as near, b.n as near_n from cuts a join cuts b on a.cut = b.cut and a.word <> b.word
    union
    select a.word, b.word, b.n from cuts a join words b on a.cut.rest = b.word
    union
    select b.word, a.word, a.n from cuts a join words b on a.cut.rest = b.word
), ranked as (
    select *, count(*) over (partition by word) as n_near,
           row_number() over (partition by word order by near_n desc, near) as place
    from pairs
), forms as (
    select w.word, w.n, coalesce(r.n_near, 0) as n_near,
           case when r.near_n >= 10 * w.n then r.near end as form,
           case when r.near_n >= 10 * w.n then r.near_n end as form_n
    from words w left join ranked r on r.word = w.word and r.place = 1
), steps(word, root) as (
    select word, form from forms where form is not null
    union all
    select s.word, f.form from steps s join forms f on f.word = s.root where f.form is not null
), roots as (
    select s.word, s.root from steps s left join forms f on f.word = s.root where f.form is null
)
select f.word, f.form, coalesce(r.root, f.word) as root, f.n, f.n_near, f.form_n
from forms f left join roots r on r.word = f.word
"""

WARC = """
select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest,
       case when later then 'revisit' else 'response' end as record_type, case when later then holder end as refers_to
from (
    select *, octet_length(encode(coalesce(html, ''))) >= 1000
              and (page_id < holder or (page_id is null and holder is not null)) as later
    from (select *, max(page_id) over (partition by coalesce(html, '')) as holder from pages)
)
"""
