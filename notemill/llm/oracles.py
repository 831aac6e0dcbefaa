"""DuckDB SQL for the queries that SQL can express."""



def _merkle(levels: int = 5, upper: int = 3) -> str:
    """The tree of every source and the tree over them, level by level; enough for 16^5 leaves a source."""
    told = lambda c: f"case when {c} is null then '-' else strlen({c}::varchar) || ':' || {c}::varchar end"
    leaf = lambda text: "sha256(" + " || ".join(told(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    # crc32 of the decimal digits: a byte is taken in, then eight times a bit is shifted out
    crc = "xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(doc_id::varchar, ''), lambda ch: list_prepend(ascii(ch)::bigint, [-1::bigint, -1, -1, -1, -1, -1, -1, -1])))), lambda c, e: case when e >= 0 then xor(c, e) else xor(c >> 1, 3988292384 * (c & 1)) end), 4294967295)"
    parts = [f"""d as (select *, {leaf("text")} as leaf, case when {crc} % 5 = 0 then {leaf("lowered")} end as tampered
  from (select *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lowered from documents)),
l as (select doc_id, source, leaf, coalesce(tampered, leaf) as changed, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos from d),
a0 as (select source, pos, leaf as h, count(*) over (partition by source) as n from l)"""]  # fmt: skip

    def tree(name: str, most: int, group: str) -> None:
        for k in range(most):
            parts.append(f"{name}{k + 1} as (select {group}, pos // 16 as pos, case when any_value(n) > 1 then sha256(string_agg(h, '' order by pos)) else any_value(h) end as h, (any_value(n) + 15) // 16 as n from {name}{k} group by all)")
            run = f"partition by {group}, pos // 16 order by pos rows between"
            parts.append(f"{name}s{k} as (select {group}, pos, n, coalesce(string_agg(h, '') over ({run} unbounded preceding and 1 preceding), '') as pre, coalesce(string_agg(h, '') over ({run} 1 following and unbounded following), '') as post from {name}{k})")

    tree("a", levels, "source")
    parts.append(f"b0 as (select 0 as one, source, row_number() over (order by source nulls first) - 1 as pos, h, count(*) over () as n from a{levels})")
    tree("b", upper, "one")
    parts.append("f0 as (select l.doc_id, l.source, l.leaf, l.pos, b.pos as at, b.h as subroot, l.changed as fold, '' as proof from l join b0 b on l.source is not distinct from b.source)")
    k = 0
    for name, most, pos, same in (("a", levels, "pos", "f.source is not distinct from s.source and"), ("b", upper, "at", "")):
        for level in range(most):
            parts.append(f"f{k + 1} as (select f.doc_id, f.source, f.leaf, f.pos, f.at, f.subroot, case when s.n > 1 then sha256(s.pre || f.fold || s.post) else f.fold end as fold, f.proof || s.pre || s.post as proof from f{k} f join {name}s{level} s on {same} f.{pos} // {16**level} = s.pos)")
            k += 1
    return f"with {', '.join(parts)} select doc_id, leaf, subroot, r.h as root, sha256(proof) as proof_sha256, fold as folded_root, fold = r.h as verified from f{k} cross join b{upper} r"


ORACLES = {
    "op3_exact_dedup": r"""
with t as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = min(doc_id) over w as kept, text_sha256
from t window w as (partition by text_sha256)""",
    "op5_urls": r"""
with p as (select page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
r(rhost, rpath, verdict) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m as (select p.page_id, rhost || rpath as rule, verdict, row_number() over (partition by p.page_id order by length(rhost || rpath) desc, length(rhost) desc) as k
  from p join r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath))
select p.page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from p left join m on p.page_id = m.page_id and m.k = 1""",
    "op11_neighbours": """
with v as (select vec_id, embedding::double[] as e, row_number() over () as r from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (select q.vec_id as query_id, c.vec_id, list_cosine_similarity(q.e, c.e) as score, q.r, row_number() over (partition by q.r order by list_cosine_similarity(q.e, c.e) desc, c.vec_id nulls last, c.r) as rank
  from v q join v c on q.vec_id % 50 = 0 and q.r <> c.r and len(q.e) = len(c.e))
select query_id, rank::int as rank, vec_id, score from p where rank <= 5""",
    "op12_merkle": _merkle(),
}
