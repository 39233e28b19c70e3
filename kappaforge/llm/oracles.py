"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

OP1 = r"""with d as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents),
 windows as (select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as h from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d where len(w) >= 50)),
 firsts as (select h, min(doc_id) as first_id from windows group by h having min(doc_id) < max(doc_id)),
 gone as (select distinct doc_id, unnest(range(i, i + 50)) as i from (select doc_id, i from windows join firsts using (h) where first_id < doc_id)),
 words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from d),
 kept as (select doc_id, count(*) as n, string_agg(word, ' ' order by i) as body from words anti join gone using (doc_id, i) group by doc_id)
 select d.doc_id, len(w) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(body, '')) as kept_sha256 from d left join kept on kept.doc_id = d.doc_id"""

OP12 = r"""with d as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
 totals as (select count(*) as n_docs, sum(len(w))::bigint as n_terms from d where len(w) > 0),
 tfs as (select doc_id, n, term, count(*) as tf from (select doc_id, len(w)::bigint as n, unnest(w) as term from d) group by doc_id, n, term),
 asked as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
 weights as (select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tfs, totals group by term, n_docs),
 impacts as (select doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))) as impact from tfs join weights using (term), totals),
 scored as (select item_id, doc_id, sum(impact)::bigint as score from asked join impacts using (term) group by item_id, doc_id having sum(impact) > 0),
 placed as (select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from scored)
 select item_id, rank::int as rank, doc_id, score from placed where rank <= 50"""

_FIELD = "coalesce(strlen({0}::varchar)::varchar || ':' || {0}::varchar, '-')"
_LEAF = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
_TEXT, _LOW = _FIELD.format("text"), _FIELD.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
 lambda s, c: list_reduce([xor(s, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)))"""
_NODES = """{0}(level, grp, i, h, n) as (select 0, grp, i, h, n from {1} union all
 select level + 1, grp, i // 16, sha256(string_agg(h, '' order by i)), (any_value(n) + 15) // 16 from {0} where n > 1 group by level, grp, i // 16),
 {0}_runs as (select level, grp, i // 16 as b, list(h order by i) as hs from {0} where n > 1 group by level, grp, i // 16)"""
_CLIMB = """{0}(rid, level, grp, i, folded, proof) as (select rid, 0, grp, i, folded, proof from {2} union all
 select rid, c.level + 1, c.grp, i // 16, sha256(array_to_string(hs[:i % 16], '') || folded || array_to_string(hs[i % 16 + 2:], '')), proof || array_to_string(hs[:i % 16], '') || array_to_string(hs[i % 16 + 2:], '')
 from {0} c join {1}_runs r on r.level = c.level and r.grp = c.grp and r.b = i // 16)"""
OP13 = f"""with recursive rows_ as (select doc_id, source, sha256({_LEAF} || {_TEXT}) as leaf, case when {_CRC} % 5 = 0 then sha256({_LEAF} || {_LOW}) end as forged from documents),
 sources as (select source, row_number() over (order by source nulls first) - 1 as g from (select distinct source from rows_)),
 leaves as (select row_number() over () as rid, doc_id, leaf, coalesce(forged, leaf) as folded, '' as proof, leaf as h, g as grp, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by g) as n
 from rows_ join sources on sources.source is not distinct from rows_.source),
 {_NODES.format("own", "leaves")},
 subroots as (select 0 as grp, grp as i, h, count(*) over () as n from own where n = 1),
 {_NODES.format("top", "subroots")},
 {_CLIMB.format("climbs", "own", "leaves")},
 at_subroot as (select rid, 0 as grp, arg_max(grp, level) as i, arg_max(folded, level) as folded, arg_max(proof, level) as proof from climbs group by rid),
 {_CLIMB.format("rises", "top", "at_subroot")},
 at_root as (select rid, arg_max(folded, level) as folded, arg_max(proof, level) as proof from rises group by rid)
 select doc_id, leaf, s.h as subroot, r.h as root, sha256(a.proof) as proof_sha256, a.folded as folded_root, a.folded = r.h as verified
 from leaves l join at_root a using (rid) join subroots s on s.i = l.grp, (select h from top where n = 1) r"""
