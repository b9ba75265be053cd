"""The operators of this folder as queries over the test tables, with SQL where SQL can say it.

Each query applies its operator to the whole table. `QUERIES` maps a name to (function, SQL
or None).
"""

import public_tokenizers
from pyspark.sql import functions as F

from riskmart.llm import (
    decontamination, exact, jaccard, knn, language, packing, pii, preference, quality, ranked, sharding, toxicity, trie,
)
from riskmart.llm.storing import kept
from riskmart.operators.keys import join_many_to_one

QUERIES = {}


def query(name, sql=None):
    def add(function):
        QUERIES[name] = (function, sql)
        return function

    return add


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


NGRAM_JACCARD_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
shingles as (
  select distinct doc_id, array_to_string(w[i : i + 4], ' ') as s
  from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) as i from words where len(w) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (
  select a.doc_id as x, b.doc_id as y, count(*) as c
  from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (
  select x, y from common join sizes p on p.doc_id = x join sizes q on q.doc_id = y
  where 100 * c >= 75 * (p.n + q.n - c)),
linked as (select x, y from links union all select y, x from links),
reach(doc_id, r) as (
  select doc_id, doc_id from documents
  union select linked.y, reach.r from reach join linked on linked.x = reach.doc_id where reach.r < linked.y)
select d.doc_id, coalesce(s.n, 0) as n_shingles, min(r.r) as component_id
from documents d left join sizes s using (doc_id) join reach r on r.doc_id = d.doc_id
group by d.doc_id, s.n
"""


@query("op8_ngram_jaccard", NGRAM_JACCARD_SQL)
def op8_ngram_jaccard(spark, folder):
    """One row per document: size of its shingle set and the smallest id linked to it."""
    return jaccard.jaccard_groups(table(spark, folder, "documents"))


@query("op1_toxicity")
def op1_toxicity(spark, folder):
    """One row per document: expected severity, grade, P(toxic) and the decision."""
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    return toxicity.score_toxicity(docs.select("doc_id", "text"), model).select(
        "doc_id", "severity", "grade", "p_toxic", (F.col("p_toxic") >= 0.5).alias("toxic")
    )


@query("op5_decontamination")
def op5_decontamination(spark, folder):
    """One row per document: whether it leaks benchmark items, which, and the best score."""
    found = decontamination.find_leaks(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        (F.size("leaks") > 0).alias("contaminated"),
        F.size("leaks").alias("n_items"),
        F.transform("leaks", lambda x: x["item"]).alias("items"),
        F.array_max(F.transform("leaks", lambda x: x["score"])).alias("best_score"),
    )


@query("op9_pii")
def op9_pii(spark, folder):
    """One row per document: pattern matches by kind, their digest, and all spans."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = pii.find_personal(docs, pii.fit(docs))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, pii.KINDS), F.sha2(listed("base_spans"), 256).alias("base_sha256"), listed("all_spans").alias("spans")
    )


@query("op4_packing")
def op4_packing(spark, folder):
    """One row per piece of a document: its place in a sequence, and a digest of its ids."""
    vocabulary = [public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("json", "tiktoken")]
    pieces = packing.token_pieces(table(spark, folder, "documents"), *vocabulary)
    digests = kept(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return packing.pack(digests, ["doc_id", "start", "salt"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def held_out(parts, rest):
    """Whether crc32 of the document's id as text leaves `rest` modulo `parts`."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == rest


@query("op6_language")
def op6_language(spark, folder):
    """One row per document: predicted language and its probability, learned from the other folds."""
    docs = table(spark, folder, "documents")
    model = language.fit(docs.where(~held_out(5, 0)))
    return language.identify(docs.select("doc_id", held_out(5, 0).alias("held_out"), "text"), model).drop("text")


@query("op3_quality")
def op3_quality(spark, folder):
    """One row per document: score and decision of trees grown on the labels outside the held-out fold."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    trees = quality.fit(docs, labels.where(~held_out(4, 2)))
    scored = quality.score_quality(docs.select("doc_id", held_out(4, 2).alias("held_out"), "text"), trees)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


EXACT_KNN_SQL = """
with good as (
  select vec_id, [cast(floor(64 * cast(x as double)) as bigint) for x in embedding] as v
  from embeddings
  where embedding is not null
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
parts as (select vec_id, unnest(v) as c, unnest(range(len(v))) as i from good),
scores as (
  select q.vec_id as query_id, x.vec_id, cast(sum(q.c * x.c) as bigint) as score
  from parts q join parts x on q.i = x.i and q.vec_id <> x.vec_id where q.vec_id % 20 = 0 group by 1, 2),
ranked as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score
  from scores)
select * from ranked where rank <= 20
"""


@query("op7_exact_knn", EXACT_KNN_SQL)
def op7_exact_knn(spark, folder):
    """The 20 highest integer inner products of each query vector."""
    return knn.top_inner_products(table(spark, folder, "embeddings"))


SHARDING_SQL = """
with hashed as (
  select doc_id, cast(strlen(coalesce(text, '')) as bigint) as n_bytes,
    cast('0x' || substr(md5(concat(coalesce(cast(doc_id as varchar), ''), ':', coalesce(text, ''))), 1, 15) as bigint) as h
  from documents),
buckets as (
  select d, h >> (60 - d) as p, sum(n_bytes) <= 1048576 or count(*) = 1 as fits
  from hashed, (select unnest(range(61)) as d) group by 1, 2),
leaves as (
  select doc_id, n_bytes, h, min(d) as depth
  from hashed join buckets on p = h >> (60 - d) where fits group by 1, 2, 3)
select doc_id, n_bytes, cast(depth as int) as depth, h >> (60 - depth) as prefix, cast(0 as bigint) as page from leaves
"""


@query("op2_sharding", SHARDING_SQL)
def op2_sharding(spark, folder):
    """One row per document: its bytes and its shard (depth, prefix, overflow page)."""
    return sharding.shard_rows(table(spark, folder, "documents"))


PREFERENCE_SQL = r"""
with turns as (
  select conv_id, role, text, row_number() over (partition by conv_id order by turn, role, text) - 1 as i
  from conversations where conv_id is not null),
marked as (
  select *, row_number() over (partition by conv_id, role = 'assistant' order by i desc) as back,
    count(*) filter (role = 'assistant') over (partition by conv_id) as answers,
    lag(text) over (partition by conv_id, role = 'assistant' order by i) as earlier
  from turns),
pairs as (
  select conv_id, i, role, text, answers, role = 'assistant' and back = 1 as is_last,
    case when role = 'assistant' and back = 1 and answers > 1 then earlier else text end as other,
    role = 'assistant' and back = 1 and answers = 1 as gone
  from marked),
firsts as (
  select conv_id, count(*) as n, min(i) filter (gone or text is distinct from other) as d from pairs group by 1),
chosen as (
  select p.conv_id, i, i < coalesce(d, n) as shared, role, concat('<|', role, '|>', chr(10)) as head, concat(text, '<|end|>', chr(10)) as body
  from pairs p join firsts using (conv_id)),
rejected as (
  select p.conv_id, i, role, concat('<|', role, '|>', chr(10)) as head, concat(other, '<|end|>', chr(10)) as body
  from pairs p join firsts using (conv_id) where i >= coalesce(d, n) and not gone),
placed as (
  select 'c' as side, *, sum(length(head) + length(body)) over (partition by conv_id order by i) as stop from (select conv_id, i, role, head, body from chosen where not shared)
  union all
  select 'r' as side, *, sum(length(head) + length(body)) over (partition by conv_id order by i) as stop from rejected),
made as (
  select conv_id, side, md5(string_agg(head || body, '' order by i)) as digest,
    string_agg(concat(cast(stop - length(body) as bigint), ':', cast(stop as bigint)), ',' order by i) filter (role = 'assistant') as mask
  from placed group by 1, 2)
select f.conv_id, cast(coalesce(d, n) as int) as n_common,
  coalesce((select md5(string_agg(head || body, '' order by i)) from chosen c where c.conv_id = f.conv_id and shared), md5('')) as prompt_md5,
  coalesce(c.digest, md5('')) as chosen_md5, coalesce(r.digest, md5('')) as rejected_md5,
  coalesce(c.mask, '') as chosen_mask, coalesce(r.mask, '') as rejected_mask
from firsts f
left join (select * from made where side = 'c') c on c.conv_id = f.conv_id
left join (select * from made where side = 'r') r on r.conv_id = f.conv_id
"""


@query("op10_preference_format", PREFERENCE_SQL)
def op10_preference_format(spark, folder):
    """One row per conversation: digests of prompt and completions, and the masks as start:end lists."""
    pairs = preference.with_stale_answer(preference.conversations(table(spark, folder, "conversations")))
    made = preference.format_preferences(pairs)

    def listed(mask):
        return F.array_join(F.transform(mask, lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias(mask)

    return made.select(
        "conv_id",
        "n_common",
        F.md5("prompt").alias("prompt_md5"),
        F.md5("chosen_completion").alias("chosen_md5"),
        F.md5("rejected_completion").alias("rejected_md5"),
        listed("chosen_mask"),
        listed("rejected_mask"),
    )


LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EXACT_DEDUP_SQL = f"""
with hashed as (select doc_id, sha256({LOWER_SQL}) as text_sha256 from documents),
groups as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from hashed group by 1)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from hashed join groups using (text_sha256)
"""


@query("op12_exact_dedup", EXACT_DEDUP_SQL)
def op12_exact_dedup(spark, folder):
    """One row per document: the document that stays for its text, and the size of its group."""
    return exact.exact_duplicates(table(spark, folder, "documents"))


RANKED_SEARCH_SQL = rf"""
with words as (
  select doc_id, row_number() over () as r,
    regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
asked as (
  select item_id, t, count(*) as times from (
    select item_id, unnest(regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t
    from (select item_id, min(text) as text from benchmark where item_id is not null group by 1)) group by 1, 2),
total as (select count(*) filter (len(w) > 0) as n, cast(sum(len(w)) as bigint) as l from words),
held as (select r, t, count(*) as tf from (select r, unnest(w) as t from words) group by 1, 2),
weights as (
  select t, cast(floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1))) as bigint) as w from held, total group by t, n),
lengths as (select r, doc_id, 100 - 25 + (25 * len(w) * n) // l as m from words, total where l > 0),
scores as (
  select item_id, r, doc_id, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) as bigint) as score
  from asked join held using (t) join weights using (t) join lengths using (r) group by 1, 2, 3),
ranked as (
  select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank, doc_id, score
  from scores where score > 0)
select * from ranked where rank <= 20
"""


@query("op11_ranked_search", RANKED_SEARCH_SQL)
def op11_ranked_search(spark, folder):
    """The 20 documents that score highest for each benchmark item."""
    return ranked.rank_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


CONVERSATION_TRIE_SQL = """
with recursive turns as (
  select conv_id as c, role, text, row_number() over (
      partition by conv_id order by turn nulls first, substr(role, 1, 32), substr(text, 1, 256), md5(concat(role, chr(0), text))) as p
  from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null)),
crc(c, digits, i, v) as (
  select distinct c, cast(c as varchar), 0, 4294967295 from turns
  union all
  select c, digits, i + 1, case when x % 2 = 1 then xor(x >> 1, 3988292384) else x >> 1 end
  from (select c, digits, i, case when i % 8 = 0 then xor(v, cast(ascii(substr(digits, i // 8 + 1, 1)) as bigint)) else v end as x
        from crc where i < 8 * length(digits))),
heads as (select c, xor(v, 4294967295) % 9 as h from crc where i = 8 * length(digits)),
rebuilt as (
  select c, role, text, row_number() over (partition by c order by own, p) as d from (
    select h.c, t.role, t.text, t.p, 0 as own from heads h join turns t on t.c = h.c - h.c % 5 where t.p <= h.h
    union all
    select h.c, t.role, t.text, t.p, 1 from heads h join turns t on t.c = h.c where t.p > h.h)),
paths as (
  select c, d, cast(strlen(text) as bigint) as bytes,
    string_agg(md5(concat(role, chr(0), text)), '') over (partition by c order by d rows unbounded preceding) as node,
    coalesce(string_agg(md5(concat(role, chr(0), text)), '') over (partition by c order by d rows between unbounded preceding and 1 preceding), '') as parent
  from rebuilt
  union all select c, 0, 0, '', null from heads),
nodes as (select node, max(parent) as parent, max(d) as d, max(bytes) as bytes, count(*) as n, min(c) as owner from paths group by node),
children as (select parent, count(*) as n_children from nodes group by parent),
whole as (select n.*, coalesce(k.n_children, 0) as n_children from nodes n left join children k on k.parent = n.node),
below as (
  select a.node, count(*) filter (w.n_children = 0) as n_leaves, sum((w.n - 1) * w.bytes) as saved
  from whole w join paths a on a.c = w.owner and a.d <= w.d group by a.node),
ends as (
  select node, sha256(string_agg(cast(c as varchar), ',' order by c)) as sha
  from (select c, max(d) as d from paths group by c) join paths using (c, d) group by node)
select w.owner as conv_id, cast(w.d as bigint) as depth, p.owner as parent_conv_id, w.n as n_convs, w.n_children,
  b.n_leaves, cast(b.saved as bigint) as saved_tokens, coalesce(e.sha, sha256('')) as ends_sha256
from whole w join below b using (node) left join nodes p on p.node = w.parent left join ends e on e.node = w.node
"""


def with_shared_openings(turns):
    """(turns, members): conversations that open with the first turns of another.

    Conversation c takes the first crc32(c) % 9 turns of conversation c - c % 5, as far as
    there are any, and goes on with its own turns after that many.
    """
    head = F.crc32(F.col("id").cast("string").cast("binary")) % 9
    sizes = kept(turns.groupBy("id").agg(F.count("*").alias("n")))
    bases = sizes.select(F.col("id").alias("base"), F.least("n", F.lit(8)).alias("base_n"))
    taken = F.least(head, F.coalesce("base_n", F.lit(0)))
    members = kept(
        sizes.withColumn("base", F.expr("id - id % 5")).join(bases, "base", "left")
        .select("id", "n", taken.alias("taken"), (taken + F.greatest(F.col("n") - head, F.lit(0))).alias("length"))
    )
    lengths = members.select("id", "taken", "length")
    own = join_many_to_one(
        turns.where(F.col("place") > head), lengths, "id", hot=trie.hot_ids(members, "id", "n", turns.count())
    ).withColumn("place", F.col("taken") + F.col("place") - head)
    near = turns.where("place <= 8 and id % 5 = 0").select(
        F.explode(F.transform(F.sequence(F.lit(-4), F.lit(4)), lambda k: F.col("id") + k)).alias("c"), "id", "place", "a", "b", "bytes"
    ).where("c - c % 5 = id")
    openings = near.drop("id").withColumnRenamed("c", "id").join(lengths, "id").where("place <= taken")
    columns = ["id", "place", "length", "a", "b", "bytes"]
    return kept(own.select(*columns).unionByName(openings.select(*columns))), members.select("id", "length")


@query("op13_conversation_trie", CONVERSATION_TRIE_SQL)
def op13_conversation_trie(spark, folder):
    """One row per distinct opening of the rebuilt conversations."""
    return trie.prefix_trie(*with_shared_openings(trie.ordered_turns(table(spark, folder, "conversations"))))
