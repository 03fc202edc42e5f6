"""The registered queries of this subpackage: thin wrappers that derive contract columns from operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op3_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import compression_bands

    return compression_bands(table(spark, sf_dir, "documents"))


def op4_bigru_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .weak_labels import quality_classifier

    return quality_classifier(table(spark, sf_dir, "documents"))


def op6_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import hilbert_shards

    return hilbert_shards(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op7_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_products

    return top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_piece_coding(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """Every text encoded and decoded again: number of ids, their digest, and whether the text came back (U+2581 as a blank)."""
    from .common import text_of
    from .pieces import decode, encode, load

    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    pieces = load(model)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.xxhash64(F.translate(text_of("text"), "\u2581", " ")).alias("mark"))
    coded = encode(docs, pieces, keep=("doc_id", "mark"))
    ids = F.col("ids")
    coded = coded.select("doc_id", "mark", "ids", F.size(ids).cast("long").alias("n_ids"), F.sha2(F.array_join(ids, " ").cast("binary"), 256).alias("ids_sha256"))
    back = decode(coded, pieces, keep=("doc_id", "mark", "n_ids", "ids_sha256"))
    return back.select("doc_id", "n_ids", "ids_sha256", (F.xxhash64("text") == F.col("mark")).alias("restored"))


def op9_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=2).select("doc_id", "n_shingles", "component_id", "kept")


def op11_time_forward_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .trie import Shape, borrowed_heads, prefix_trie

    turns = table(spark, sf_dir, "conversations")
    own = F.col("conv_id")
    return prefix_trie(borrowed_heads(turns, own - own % 100, F.crc32(own.cast("string")) % 6, most=5), Shape())


def op12_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resampling import Plan, resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Plan()).drop("n_words")


QUERIES = {
    "op11_time_forward_trie": op11_time_forward_trie,
    "op12_page_differencing": op12_page_differencing,
    "op13_importance_resampling": op13_importance_resampling,
    "op7_threshold_topk": op7_threshold_topk,
    "op8_piece_coding": op8_piece_coding,
    "op4_bigru_toxicity": op4_bigru_toxicity,
    "op5_weak_label_quality": op5_weak_label_quality,
    "op10_minmax_near_dedup": op10_minmax_near_dedup,
    "op1_packing": op1_packing,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_compression_bands": op3_compression_bands,
    "op9_warc_segments": op9_warc_segments,
    "op6_hilbert_sharding": op6_hilbert_sharding,
}

#: DuckDB equivalents, where SQL can express the whole query.
ORACLES: dict[str, str] = {
    "op7_threshold_topk": """
        with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q from embeddings
                   where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
             s as (select a.vec_id as query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::bigint as score
                   from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
             r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as n from s)
        select query_id, n::int as rank, vec_id, score from r where n <= 5
    """,
    "op9_warc_segments": """
        with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as g from pages),
             m as (select g, min(page_id) as first_id from p where n >= 100 group by g)
        select p.page_id, p.n::bigint as payload_bytes, p.g as payload_digest,
               case when m.first_id < p.page_id then 'revisit' else 'response' end as record_type,
               case when m.first_id < p.page_id then m.first_id end as refers_to
        from p left join m on p.g = m.g and p.n >= 100
    """,
    # Every window of 400 bytes by its digest; covered bytes are gaps and islands of the repeated starts.
    "op2_suffix_dedup": r"""
        with d as (select doc_id, row_number() over () as r, encode(coalesce(text, '')) as h from documents),
             n as (select r, doc_id, h, octet_length(h) as n from d),
             w as (select r, unnest(range(0, n - 399)) as s, h from n where n >= 400),
             k as (select r, s, md5(h[s + 1:s + 400]) as k from w),
             m as (select k from k group by k having count(*) > 1),
             p as (select r, s from k join m using (k)),
             g as (select r, s, case when s > lag(s) over (partition by r order by s) + 400 or lag(s) over (partition by r order by s) is null then 1 else 0 end as fresh from p),
             u as (select r, s, sum(fresh) over (partition by r order by s rows unbounded preceding) as u from g),
             z as (select r, u, min(s) as a, max(s) + 400 as b from u group by r, u),
             y as (select r, a, b, lag(b, 1, 0) over (partition by r order by a) as before from z),
             x as (select r, sum(b - a) as gone, count(*) as spans, max(b) as last, string_agg(hex(h[before + 1:a]), '' order by a) as kept from y join n using (r) group by r)
        select doc_id, n::bigint as n_bytes, coalesce(gone, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans,
               sha256(case when x.r is null then h else unhex(kept) || h[last + 1:n] end) as kept_sha256
        from n left join x using (r)
    """,
    # Sets of equal shingles once; candidates by prefix filtering, which loses no pair at 0.8; then whole sets.
    "op10_minmax_near_dedup": r"""
        with recursive d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
             w as (select doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w from d),
             s as (select doc_id, case when len(w) >= 2 then list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) when len(w) = 1 then w else [] end as s from w),
             f as (select doc_id, len(s) as n, md5(array_to_string(list_sort(s), chr(10))) as g from s),
             c as (select min(doc_id) as id, g from f where n > 0 group by g),
             k as (select c.id, len(s) as n, s from c join s on s.doc_id = c.id),
             e as (select id, n, unnest(s) as x from k),
             r as (select x, count(*) as c from e group by x),
             o as (select id, n, x, row_number() over (partition by id order by c, x) as p from e join r using (x)),
             h as (select * from o where p <= n - (8 * n + 9) // 10 + 1),
             q as (select distinct a.id as a, b.id as b from h a join h b on a.x = b.x and a.id < b.id and 10 * least(a.n, b.n) >= 8 * greatest(a.n, b.n)),
             i as (select q.a, q.b, len(list_intersect(x.s, y.s)) as m, x.n as p, y.n as q from q join k x on x.id = q.a join k y on y.id = q.b),
             l as (select a, b from i where 100 * m >= 80 * (p + q - m) union select b, a from i where 100 * m >= 80 * (p + q - m)),
             t as (select id as node, id as root from c union select l.b, t.root from t join l on l.a = t.node where t.root < l.b),
             v as (select node, min(root) as root from t group by node)
        select f.doc_id, f.n::bigint as n_shingles, coalesce(v.root, f.doc_id) as component_id, f.doc_id = coalesce(v.root, f.doc_id) as kept
        from f left join c on c.g = f.g and f.n > 0 left join v on v.node = c.id
    """,
    # Unsigned CRC-32 by its table of 256; counts by bucket, then the same doubles.
    "op13_importance_resampling": r"""
        with tab as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as tab),
             src as (select row_number() over () as r, doc_id, 0 as side, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
                     union all select null, null, 1, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') from benchmark),
             o as (select r, side, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from src),
             c as (select r, side, w, count(*) as n from o group by r, side, w),
             u as (select distinct w, encode(w) as h from c),
             k as (select w, xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(h)), lambda j: ('0x' || hex(h[j + 1:j + 1]))::bigint)), lambda c, y: xor(c >> 8, tab[(xor(c, y) & 255) + 1])), 4294967295) % 10000 as b from u, tab),
             b as (select b, coalesce(sum(n) filter (where side = 0), 0)::bigint as s, coalesce(sum(n) filter (where side = 1), 0)::bigint as t from c join k using (w) group by b),
             z as (select sum(s)::bigint as s, sum(t)::bigint as t from b),
             g as (select b.b, floor(1000 * ln(((b.t + 1) * (z.s + 10000))::double / ((b.s + 1) * (z.t + 10000))::double))::bigint as gain from b, z),
             f as (select r, sum(n)::bigint as n, floor(sum(n * gain)::bigint / sum(n)::bigint)::bigint as weight from c join k using (w) join g using (b) where side = 0 group by r),
             d as (select doc_id, coalesce(f.n, 0) as n_features, coalesce(weight, 0) as weight, ('0x' || sha256('2024:' || coalesce(doc_id::varchar, ''))[:8])::bigint as h from src left join f using (r) where side = 0),
             e as (select doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint as score from d),
             p as (select *, case when n_features >= 20 then row_number() over (partition by n_features >= 20 order by score desc, doc_id, n_features) end as place, count(*) filter (where n_features >= 20) over () as able from e)
        select doc_id, n_features::bigint as n_features, weight, score, case when place <= 10 * able // 100 then place end as rank from p
    """,
    # Every prefix by the list of its turns' digests; totals over all pairs of a node and an ancestor.
    "op11_time_forward_trie": r"""
        with tab as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as tab),
             o as (select conv_id as c, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as x, length(coalesce(text, '')) as n,
                          row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as i from conversations where conv_id is not null),
             l as (select c, list({'x': x, 'n': n} order by i) as t from o group by c),
             h as (select c, t, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(c::varchar)), lambda j: ascii(substr(c::varchar, j + 1, 1))::bigint)), lambda a, y: xor(a >> 8, tab[(xor(a, y) & 255) + 1])), 4294967295) % 6 as h from l, tab),
             r as (select h.c, coalesce(b.t[:h], []) || h.t[h + 1:] as t from h left join l b on b.c = h.c - h.c % 100),
             p as (select c, t, len(t) as size, unnest(range(len(t) + 1)) as d from r),
             k as (select c, d, size, md5(array_to_string(list_transform(t[:d], lambda z: z.x), ',')) as k, case when d > 0 then t[d].n else 0 end as chars from p),
             g as (select d, k, min(c) as node, count(*) as n_convs, any_value(chars) as chars, string_agg(c::varchar, ',' order by c) filter (where d = size) as ids from k group by d, k),
             m as (select k.c, k.d, g.node, g.n_convs, g.chars from k join g using (d, k)),
             v as (select g.d, g.node, g.n_convs, g.ids, u.node as parent, (g.n_convs - 1) * g.chars as saved from g left join m u on u.c = g.node and u.d = g.d - 1),
             f as (select d - 1 as d, parent as node, count(*) as n from v where parent is not null group by d, parent),
             w as (select v.d, v.node, v.saved, case when f.n is null then 1 else 0 end as leaf from v left join f using (d, node)),
             s as (select a.d, a.node, sum(w.leaf)::bigint as leaves, sum(w.saved)::bigint as saved from w join m a on a.c = w.node and a.d <= w.d group by a.d, a.node)
        select v.node as conv_id, v.d as depth, v.parent as parent_conv_id, v.n_convs::bigint as n_convs, coalesce(f.n, 0)::bigint as n_children, s.leaves as n_leaves, s.saved as saved_tokens, sha256(coalesce(v.ids, '')) as ends_sha256
        from v join s using (d, node) left join f using (d, node)
    """,
}
