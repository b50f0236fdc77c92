"""The operators with production parameters over whole tables, and SQL stating their results where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leverwise.llm import (
    collocations, conversations, decontaminate, embeddings, language, minhash, packing, pii, quality, substrings, token_counts, token_files,
    toxicity,
)
from leverwise.llm.common import read_table


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_output(read_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.drop("spans")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.identifiers(read_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(read_table(spark, sf_dir, "embeddings"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(read_table(spark, sf_dir, "documents"))


def op9_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.without_repeats(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.prefix_trie(read_table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_token_files": op2_token_files,
    "op10_token_counts": op10_token_counts,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op4_pii": op4_pii,
    "op7_toxicity": op7_toxicity,
    "op3_embedding_near_dedup": op3_embedding_near_dedup,
    "op8_language_id": op8_language_id,
    "op9_quality_resampling": op9_quality_resampling,
    "op11_collocations": op11_collocations,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_conversation_trie": op13_conversation_trie,
}

FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DUPLICATES_SQL = f"""
with recursive words as (
    select doc_id, regexp_extract_all({FOLDED}, '[^\\x20\\x09-\\x0D]+') as w from documents
),
sets as (
    select doc_id, case
        when len(w) >= 5 then list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)])
        when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s
    from words
),
items as (select doc_id, len(s) as n, unnest(s) as item from sets),
links as (
    select a.doc_id as x, b.doc_id as y
    from items a join items b on a.item = b.item and a.doc_id <> b.doc_id
    group by a.doc_id, b.doc_id, a.n, b.n
    having 100 * count(*) >= 75 * (a.n + b.n - count(*))
),
reached(x, y) as (
    select doc_id, doc_id from documents
    union
    select reached.x, links.y from reached join links on links.x = reached.y
),
least as (select x, min(y) as component_id from reached group by x)
select doc_id, len(s) as n_shingles, component_id, doc_id = component_id as kept
from sets join least on least.x = sets.doc_id
"""

CONTAMINATION_SQL = f"""
with said as (
    select doc_id, regexp_extract_all({FOLDED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents
),
asked as (
    select item_id, regexp_extract_all({FOLDED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark
),
phrases as (
    select distinct item_id, least(10, len(w)) as size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') as phrase
    from (select *, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from asked where len(w) > 0)
),
places as (
    select doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') as phrase
    from (select *, unnest(range(1, len(w) - size + 2)) as i from said, (select distinct size from phrases))
),
found as (select doc_id, i, size, item_id from places join phrases using (size, phrase)),
hit as (
    select doc_id, count(distinct word) as n_hit
    from (select doc_id, unnest(range(i, i + size)) as word from found) group by doc_id
),
items as (
    select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as named
    from (select distinct doc_id, cast(item_id as varchar) as item from found) group by doc_id
)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
    sha256(coalesce(named, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from said left join hit using (doc_id) left join items using (doc_id)
"""

NEAR_VECTORS_SQL = """
with recursive usable as (
    select vec_id, label, [cast(x as double) for x in embedding] as v from embeddings
    where label is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0
        and len([x for x in embedding if x <> 0]) > 0
),
links as (
    select a.vec_id as x, b.vec_id as y from usable a join usable b on a.label = b.label and a.vec_id <> b.vec_id
    where len(a.v) = len(b.v) and list_cosine_similarity(a.v, b.v) >= 0.98
),
reached(x, y) as (
    select vec_id, vec_id from embeddings
    union
    select reached.x, links.y from reached join links on links.x = reached.y
),
least as (select x, min(y) as component_id from reached group by x),
many as (select x, count(*) as n from links group by x)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept
from embeddings left join least on least.x = vec_id left join many on many.x = vec_id
"""

# The CRC-32 is taken bit by bit; a prefix is named by the hash of its turns.
CONVERSATION_TRIE_SQL = """
with said as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null
),
placed as (
    select conv_id, strlen(text) as size, sha256(strlen(role) || ':' || role || text) as mark,
        row_number() over (partition by conv_id order by turn nulls first, sha256(strlen(role) || ':' || role || text)) as place
    from said
),
heads as (
    select conv_id, conv_id - conv_id % 5 as head, xor(list_reduce(
        list_concat([4294967295::bigint], [ord(c)::bigint for c in string_split(conv_id::varchar, '')]),
        lambda crc, byte: list_reduce(
            list_concat([xor(crc, byte)], [0::bigint for i in range(8)]),
            lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))
    ), 4294967295) % 9 as h
    from (select distinct conv_id from said)
),
rebuilt as (
    select c.conv_id, t.place, t.mark, t.size from heads c join placed t on t.conv_id = c.head and t.place <= c.h
    union all
    select c.conv_id, least(c.h, coalesce(n, 0)) + t.place - c.h, t.mark, t.size from heads c
    join placed t on t.conv_id = c.conv_id and t.place > c.h
    left join (select conv_id as head, count(*) as n from placed group by 1) using (head)
),
whole as (
    select h.conv_id, coalesce(list(mark order by place) filter (mark is not null), []) as marks,
        coalesce(list(size order by place) filter (mark is not null), []) as sizes
    from heads h left join rebuilt r using (conv_id) group by 1
),
steps as (
    select conv_id, d, sha256(array_to_string(marks[1:d], ',')) as node, sha256(array_to_string(marks[1:d - 1], ',')) as up,
        case when d > 0 then sizes[d] else 0 end as size, d = len(marks) as last
    from (select *, unnest(range(len(marks) + 1)) as d from whole)
),
nodes as (
    select node, d, any_value(up) as up, any_value(size) as size, min(conv_id) as conv_id, count(*) as n_convs,
        sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (last), '')) as ends_sha256
    from steps group by node, d
),
below as (select up, d - 1 as d, count(*) as n_children from nodes where d > 0 group by up, d),
counted as (
    select n.*, coalesce(n_children, 0) as n_children, (n_convs - 1) * size as saved
    from nodes n left join below b on b.up = n.node and b.d = n.d
),
inside as (
    select a.node, a.d, b.node as lower, b.d as lower_d from steps a join steps b on a.conv_id = b.conv_id and a.d <= b.d
    group by all
),
summed as (
    select i.node, i.d, count(*) filter (c.n_children = 0) as n_leaves, sum(c.saved) as saved_tokens
    from inside i join counted c on c.node = i.lower and c.d = i.lower_d group by i.node, i.d
)
select c.conv_id, c.d as depth, p.conv_id as parent_conv_id, c.n_convs, c.n_children, n_leaves,
    cast(saved_tokens as bigint) as saved_tokens, c.ends_sha256
from counted c join summed s on s.node = c.node and s.d = c.d
left join counted p on c.d > 0 and p.node = c.up and p.d = c.d - 1
"""

COLLOCATIONS_SQL = f"""
with said as (
    select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from (
        select coalesce(lang, 'und') as lang, unnest(string_split_regex({FOLDED}, '[.,;:!?\\x0A-\\x0D]')) as piece from documents
    )
),
totals as (select lang, cast(sum(len(w)) as bigint) as n from said group by lang),
counts as (
    select lang, words, count(*) as f from (
        select lang, w[i:i + m - 1] as words from (
            select lang, w, m, unnest(range(1, len(w) - m + 2)) as i from said, (select unnest(range(1, 6)) as m) where len(w) >= m
        )
    ) group by lang, words
),
candidates as (select lang, words, f as a from counts where len(words) > 1 and f >= 100),
inner_phrases as (
    select lang, words[i:i + m - 1] as words, max(a) as longest from (
        select lang, words, a, m, unnest(range(1, len(words) - m + 2)) as i
        from candidates, (select unnest(range(2, 5)) as m) where len(words) > m
    ) group by all
),
kept as (
    select c.* from candidates c left join inner_phrases i using (lang, words) where coalesce(i.longest, 0) < c.a
),
cuts as (
    select k.lang, k.words, k.a, cut, x.f as l, y.f as r, t.n,
        (1000::hugeint * k.a * t.n) // (x.f::hugeint * y.f) as score
    from (select *, unnest(range(1, len(words))) as cut from kept) k
    join counts x on x.lang = k.lang and x.words = k.words[1:cut]
    join counts y on y.lang = k.lang and y.words = k.words[cut + 1:]
    join totals t on t.lang = k.lang
),
weakest as (select * from cuts qualify row_number() over (partition by lang, words order by score, cut) = 1),
ranked as (
    select lang, row_number() over (partition by lang order by score desc, a desc, array_to_string(words, ' ')) as rank,
        array_to_string(words, ' ') as phrase, a, l, r, n, cast(score as bigint) as score
    from weakest
)
select * from ranked where rank <= 2000
"""

SUBSTRING_DEDUP_SQL = """
with said as (
    select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents
),
windows as (
    select r, doc_id, i, array_to_string(w[i:i + 12], ' ') as phrase
    from (select *, unnest(range(1, len(w) - 11)) as i from said where len(w) >= 13)
),
least as (select phrase, min(doc_id) as first from windows group by phrase),
gone as (select distinct r, unnest(range(i, i + 13)) as i from windows join least using (phrase) where doc_id > first),
words as (select r, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from said),
kept as (select r, string_agg(word, ' ' order by i) as text from words anti join gone using (r, i) group by r),
removed as (select r, count(*) as n from gone group by r)
select doc_id, len(w) as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(text, '')) as kept_sha256
from said left join kept using (r) left join removed using (r)
"""

SQL: dict[str, str] = {
    "op11_collocations": COLLOCATIONS_SQL,
    "op12_substring_dedup": SUBSTRING_DEDUP_SQL,
    "op13_conversation_trie": CONVERSATION_TRIE_SQL,
    "op3_embedding_near_dedup": NEAR_VECTORS_SQL,
    "op1_minhash_near_dedup": NEAR_DUPLICATES_SQL,
    "op5_benchmark_decontamination": CONTAMINATION_SQL,
}
