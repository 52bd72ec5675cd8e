"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeaudit.llm.collocations import collocations
from codeaudit.llm.common import table
from codeaudit.llm.conversations import damage, repair_conversations
from codeaudit.llm.decontaminate import decontaminate
from codeaudit.llm.jaccard import jaccard_components
from codeaudit.llm.knn import knn_join
from codeaudit.llm.language import fit, label
from codeaudit.llm.license_scan import BASE, TEMPLATES, needed, scan_licenses, split
from codeaudit.llm.lines import dedup_lines
from codeaudit.llm.packing import encode, pack
from codeaudit.llm.pii import pseudonymise
from codeaudit.llm.shards import shard
from codeaudit.llm.suffixes import repeated_passages
from codeaudit.llm.warc import archive, records


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return d.select("doc_id", "n_words", "n_hit", "n_items",
                    F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
                    (F.col("n_hit") > 0).alias("contaminated"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
                    F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
                    F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "text", "line_dedup.n_lines", "line_dedup.n_removed")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = archive(table(spark, sf_dir, "pages"))
    return records(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op1_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_join(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    found = label(docs, fit(docs.filter(fold != 2)))
    return found.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "spans")


def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), "corpus key")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), encode)


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents")).drop("__row")


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damage(table(spark, sf_dir, "conversations")), present="present")


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("places", lambda x: x["base"])
    joined = lambda places: F.array_join(F.array_sort(F.array_distinct(places["label"])), ",")
    return d.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(base["start"]).alias("first_word"),
                    F.array_max(base["start"]).alias("last_word"), joined(base).alias("base_labels"),
                    joined(F.col("places")).alias("labels"),
                    F.coalesce(F.array_max(F.transform("places", lambda x: x["matched"] / x["words"])), F.lit(0.0)).alias("score"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {"op1_knn": op1_knn, "op2_language": op2_language, "op3_pseudonyms": op3_pseudonyms,
           "op4_decontaminate": op4_decontaminate, "op5_shards": op5_shards, "op6_jaccard_join": op6_jaccard_join,
           "op7_line_dedup": op7_line_dedup, "op8_packing": op8_packing, "op9_warc": op9_warc,
           "op10_passages": op10_passages, "op11_conversations": op11_conversations,
           "op12_licenses": op12_licenses, "op13_collocations": op13_collocations}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

# op11: the cheapest repair from row p on, per grammar state, as (cost, audit, text); the last rows come first.
_DELETE = "{'c': 3 + v%d.c, 'a': 'D' || v%d.a, 't': v%d.t}"
_INSERT = "{'c': 2 + %s.c, 'a': 'I' || %s.a, 't': chr(10) || '%s:' || %s.t}"


def _edit(letter: str, cost: str, to: int, role: str, allowed: str) -> str:
    return (f"case when {allowed} then {{'c': {cost} + cut + v{to}.c, 'a': '{letter}' || v{to}.a, "
            f"'t': chr(10) || {role} || ':' || text || v{to}.t}} end")


def _best(q: int) -> str:
    to, role = (3, "assistant") if q == 2 else (2, "user")
    keeps = [_edit("K", "0", to, "role", f"ok and left(role, 1) = '{role[0]}'")]
    keeps += [_edit("K", "0", 1, "role", "ok and left(role, 1) = 's'")] if q == 0 else []
    options = [_DELETE % (q, q, q), _edit("R", "2", to, f"'{role}'", "ok"), *keeps]
    return f"list_min(list_filter([{', '.join(options)}], lambda x: x is not null)) as b{q}"


def _insert(v: str, role: str) -> str:
    return _INSERT % (v, v, role, v)


def _template_rows() -> str:
    """The templates of op12 as rows: number, label, base, words that must
    match, words, key phrases."""
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    return ",\n     ".join(
        f"({n}, '{t.label}', {str(n < len(BASE)).lower()}, {needed(t)}, {quoted(split(t.text))}, "
        f"{'[' + ', '.join(quoted(split(p)) for p in t.phrases) + ']' if t.phrases else '[]::varchar[][]'})"
        for n, t in enumerate((*BASE, *TEMPLATES)))


ORACLES = {
    "op1_knn": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as e from embeddings
           where vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
     s as (select q.vec_id as query_id, v.vec_id, list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2]))::bigint as score
           from v as q, v where q.vec_id % 100 = 0 and q.vec_id <> v.vec_id)
select query_id, rank, vec_id, score
from (select *, (row_number() over (partition by query_id order by score desc, vec_id))::integer as rank from s) where rank <= 10""",
    "op4_decontaminate": rf"""
with d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
     i as (select item_id, {_WORDS} as w from benchmark),
     iw as (select distinct item_id, least(10, len(w)) as n,
                   unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda p: w[p:p + least(10, len(w)) - 1])) as g
            from i where len(w) > 0),
     lens as (select distinct n from iw),
     dw as (select r, n, unnest(range(1, len(w) - n + 2)) as p, w from d, lens where len(w) >= n),
     hit as (select r, p, dw.n, item_id from dw join iw on dw.n = iw.n and dw.w[p:p + dw.n - 1] = iw.g),
     pos as (select r, count(distinct q) as n_hit from (select r, unnest(range(p, p + n)) as q from hit) group by r),
     its as (select r, list_sort(list(distinct item_id::varchar)) as ids from hit group by r)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(len(ids), 0)::bigint as n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join pos using (r) left join its using (r)""",
    "op7_line_dedup": """
with d as (select doc_id, text, string_split(text, chr(10)) as l from documents),
     w as (select doc_id, l, unnest(range(1, len(l) - 1)) as p from d where len(l) >= 3),
     g as (select doc_id, p, row_number() over (partition by l[p:p + 2] order by doc_id, p) as k from w
           where regexp_matches(array_to_string(l[p:p + 2], chr(10)), '\\S')),
     gone as (select doc_id, list(distinct q) as q from (select doc_id, unnest([p, p + 1, p + 2]) as q from g where k > 1)
              group by doc_id)
select doc_id, case when q is null then text
                    else coalesce(array_to_string([l[i] for i in range(1, len(l) + 1) if not list_contains(q, i)], chr(10)), '') end as text,
       coalesce(len(l), 0)::bigint as n_lines, coalesce(len(q), 0)::bigint as n_removed
from d left join gone using (doc_id)""",
    "op9_warc": """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
     h as (select page_id, octet_length(b)::bigint as payload_bytes, sha1(b) as payload_digest,
                  max(page_id) over (partition by sha1(b), octet_length(b)) as kept from p)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 1000 and page_id <> kept then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 1000 and page_id <> kept then kept end as refers_to
from h""",
    "op13_collocations": rf"""
with p as (select coalesce(lang, 'und') as lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) as s from documents),
     w as (select lang, regexp_extract_all(s, '[^\x20\x09]+') as w from p),
     g as (select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase, count(*) as f
           from (select lang, w, unnest(range(1, len(w) + 1)) as i from w), (select unnest(range(1, 6)) as k)
           where i + k - 1 <= len(w) group by lang, k, phrase),
     t as (select lang, sum(f)::hugeint as n from g where k = 1 group by lang),
     q as materialized (select lang, phrase, k, f, string_split(phrase, ' ') as v from g where f >= 100),
     c as (select * from q where k > 1),
     gone as (select distinct c.lang, c.phrase
              from (select lang, f, array_to_string(v[i:i + j - 1], ' ') as phrase
                    from c, (select unnest(range(2, 5)) as j), (select unnest(range(1, 5)) as i) where j < k and i + j - 1 <= k) x
              join c using (lang, phrase) where 100 * x.f >= 100 * c.f),
     h as (select lang, phrase, f as a, h, array_to_string(v[1:h], ' ') as x, array_to_string(v[h + 1:], ' ') as y
           from (select *, unnest(range(1, k)) as h from c)),
     cut as (select h.lang, h.phrase, a, l.f as l, r.f as r, n, h, ((1000 * a::hugeint * n) // (l.f::hugeint * r.f))::bigint as score
             from h join t using (lang) join q as l on l.lang = h.lang and l.phrase = x join q as r on r.lang = h.lang and r.phrase = y),
     best as (select * from cut qualify row_number() over (partition by lang, phrase order by score, h) = 1),
     ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank
                from best anti join gone using (lang, phrase))
select lang, rank, phrase, a, l, r, n::bigint as n, score from ranked where rank <= 2000""",
    "op11_conversations": rf"""
with recursive
     crc as (select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
                    case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) as t),
     k as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
                  list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''),
                                 lambda c: ord(c)::bigint) as b from conversations),
     f as (select k.*, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]), 4294967295::bigint), 4294967295) % 20 as f
           from k, crc),
     d as (select conv_id, turn, case when f = 4 then 'user' else role end as role,
                  case f when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
                  unnest(range(case when f = 3 then 2 else 1 end)) as copy from f where f <> 0),
     o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(text)) as p,
                  count(*) over (partition by conv_id) as n from d),
     e as (select *, not regexp_matches(text, '[^\x20\x09-\x0D]') as blank,
                  row_number() over (partition by conv_id, role, text order by p) > 1 as again,
                  regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) not in ('.', '!', '?') as tail,
                  left(lag(role) over (partition by conv_id order by p), 1) || left(role, 1) as two from o),
     g as materialized (select *, not blank and not again as ok, (not blank and not again and tail)::bigint as cut from e),
     r as (select conv_id, max(n) + 1 as p, {{'c': 0::bigint, 'a': '', 't': ''}} as v0, {{'c': 4::bigint, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}} as v1,
                  {{'c': 2::bigint, 'a': 'I', 't': chr(10) || 'assistant:'}} as v2, {{'c': 0::bigint, 'a': '', 't': ''}} as v3
           from g group by conv_id
           union all
           select conv_id, p, list_min([b0, {_insert("x2", "user")}]), list_min([b1, {_insert("x2", "user")}]), x2, x3
           from (select *, list_min([b2, {_insert("b3", "assistant")}]) as x2, list_min([b3, {_insert("b2", "user")}]) as x3
                 from (select g.conv_id, g.p, {_best(0)}, {_best(1)}, {_best(2)}, {_best(3)}
                       from r join g on g.conv_id is not distinct from r.conv_id and g.p = r.p - 1))),
     s as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank,
                  count(*) filter (again and not blank) as duplicate, sum(cut) as truncated,
                  count(*) filter (two not in ('su', 'ua', 'au')) as illegal from g group by conv_id)
select i.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
       coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(v0.c, 0)::bigint as cost,
       coalesce(v0.a, '') as audit, sha256(coalesce(substr(v0.t, 2), '')) as repaired_sha256
from (select distinct conv_id from conversations) i left join s on s.conv_id is not distinct from i.conv_id
     left join r on r.conv_id is not distinct from i.conv_id and r.p = 1""",
    "op12_licenses": rf"""
with t(tid, label, base, need, tw, phrases) as (values
     {_template_rows()}),
     tw as (select tid, need, unnest(tw) as word, unnest(range(len(tw))) as j from t),
     d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
     dw as (select r, unnest(w) as word, unnest(range(len(w))) as p from d),
     al as (select r, tid, p - j as s, count(*) as m from dw join tw using (word) group by r, tid, p - j, need having count(*) >= need),
     ok as (select r, s, m, label, base, len(tw) as n from al join t using (tid) join d using (r)
            where len(list_filter(phrases, lambda ph: not list_contains(list_transform(
                range(greatest(s, 0), s + len(tw) - len(ph) + 1), lambda x: w[x + 1:x + len(ph)]), ph))) = 0),
     a as (select r, count(*) filter (base) as n_base, min(s) filter (base) as first_word, max(s) filter (base) as last_word,
                  list_sort(list(distinct label) filter (base)) as bl, list_sort(list(distinct label)) as ll, max(m / n) as score
           from ok group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word,
       last_word::bigint as last_word, coalesce(array_to_string(bl, ','), '') as base_labels,
       coalesce(array_to_string(ll, ','), '') as labels, coalesce(score, 0)::double as score
from d left join a using (r)""",
}
