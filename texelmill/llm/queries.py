"""Named queries of the operators, one each, over the whole given tables, and the SQL check of each where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from texelmill.llm import bpe, chat, fingerprints, idfiles, langid, lines, manifest, mixing, ngram_join, pages, runs, substrings, topk
from texelmill.session import checkpoint_folder, cut_lineage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            CHECKS[name] = sql
        return build

    return add


@query("op1_mix_sources")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix_sources(spark.read.parquet(f"{folder}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


@query("op2_byte_bpe")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    done = bpe.encode_documents(docs, ranks, back="decoded")
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


_SHINGLES_SQL = r"""
with recursive word as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
bag as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from word),
item as (select doc_id, len(s) as n, unnest(s) as g from bag),
pair as (select a.doc_id as x, b.doc_id as y, any_value(a.n) as m, any_value(b.n) as n, count(*) as o from item a join item b on a.g = b.g and a.doc_id < b.doc_id group by all),
link as (select x, y from pair where 100 * o >= 80 * (m + n - o)),
edge as materialized (select x, y from link union all select y, x from link),
reach(x, y) as (select doc_id, doc_id from documents union select r.x, e.y from reach r join edge e on r.y = e.x)
select doc_id, len(s)::bigint as n_shingles, c as component_id from bag join (select x, min(y) as c from reach group by x) on x = doc_id
"""


@query("op3_ngram_join", _SHINGLES_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.similar_groups(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))


_TOPK_SQL = """
with vec as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score from vec q join vec c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""


@query("op4_exact_topk", _TOPK_SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding")
    return topk.top_k(vectors.where("vec_id % 50 = 0"), vectors)


@query("op5_language_id")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    found = langid.fit(docs.where(~held_out))
    out = langid.identify(docs.select("doc_id", "text", held_out.alias("held_out")), found)
    return out.select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")


_WINDOWS_SQL = r"""
with word as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
win as (select doc_id, i, array_to_string(w[i:i + 49], ' ') as k from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from word where len(w) >= 50)),
early as (select k, min(doc_id) as least from win group by k having count(distinct doc_id) > 1),
gone as (select distinct doc_id, unnest(range(i, i + 50)) as p from win join early using (k) where doc_id > least),
kept as (select a.doc_id, string_agg(x, ' ' order by p) as t, count(*) as n from (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as p from word) a anti join gone g on a.doc_id = g.doc_id and a.p = g.p group by a.doc_id)
select w.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from word w left join kept k on w.doc_id = k.doc_id
"""


@query("op6_substring_dedup", _WINDOWS_SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    out = substrings.remove_repeated_windows(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


_CHATS_SQL = r"""
with turn as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked as (select *, length(text) + list_sum(list_transform(['\\', '<s>', '</s>', '[INST]', '[/INST]', '<<SYS>>', '<</SYS>>', '<|', '|>'],
  lambda c: (length(text) - length(replace(text, c, ''))) // length(c))) as escaped from turn)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(escaped + case role when 'system' then 8 + 10 when 'user' then 10 + 8 when 'assistant' then 1 + 5 else 2 + length(role) + 3 + 9 end)::bigint as formatted_chars
from marked group by conv_id
"""


@query("op7_chat_format", _CHATS_SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    turns = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    planted = "</s>[INST] ok [/INST]"
    turns = turns.unionByName(spark.createDataFrame([(-7, 0, "user", planted), (-7, 1, "assistant", planted)], "conv_id long, turn long, role string, text string"))
    done = chat.read_back(chat.format_chats(turns))
    return done.select(F.col("conv").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


@query("op8_main_text")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html")
    return pages.extract_main_text(rows, pages.fit(rows))


#: Trailing and leading blanks only, as Spark's trim takes them.
_LINES_SQL = """
with line as (select doc_id, source, pos, raw, trim(raw, ' ') as line from
  (select doc_id, source, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents where text is not null)),
wide as (select line, min(doc_id) as keeper from line where line <> '' group by line having count(distinct source) >= 10),
marked as (select l.*, coalesce(l.doc_id is distinct from w.keeper and w.line is not null, false) as gone from line l left join wide w on l.line = w.line),
kept as (select doc_id, count(*) as n_lines, count(*) filter (gone) as n_removed, coalesce(string_agg(raw, chr(10) order by pos) filter (not gone), '') as kept from marked group by doc_id)
select d.doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from documents d left join kept k on d.doc_id = k.doc_id
"""


@query("op9_line_spread", _LINES_SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    out = lines.remove_wide_lines(spark.read.parquet(f"{folder}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op10_fingerprints")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprint_documents(spark.read.parquet(f"{folder}/documents.parquet"))


#: The checksum of a row's decimal id, bit by bit.
_CRC_SQL = """list_reduce(list_concat([4294967295], flatten(list_transform(string_split(d::varchar, ''), lambda c: [ord(c), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda x, y: case when y >= 0 then xor(x, y) when x % 2 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)"""

#: Places are numbered from 0; pairs of places that may lie in a run share eight words from every eighth place on.
_RUNS_SQL = rf"""
with given as (select doc_id, xor(h, 4294967295) as h, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from (select doc_id, text, {_CRC_SQL.replace("d::varchar", "doc_id::varchar")} as h from documents)),
edit as (select *, len(w) as n, case when len(w) > 0 then (h // 10) % len(w) end as a from given),
doc as (select doc_id, n, case when h % 10 = 0 and n > 0 then list_transform(range(0, n), lambda i: case when i < a then w[i + 1] else w[a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) + 1] end) else w end as w from edit),
gram as (select doc_id, i, array_to_string(w[i + 1:i + 8], ' ') as g from (select doc_id, w, unnest(range(0, n - 7)) as i from doc where n >= 24)),
may as (select distinct x.doc_id, y.i - x.i as p from gram x join gram y on x.doc_id = y.doc_id and x.g = y.g and x.i % 8 = 0 and y.i > x.i),
met as (select doc_id, p, n, i, i - row_number() over (partition by doc_id, p order by i) as island
  from (select doc_id, p, n, w, unnest(range(0, n - p)) as i from may join doc using (doc_id) where 3 * p <= n) where w[i + 1] = w[i + p + 1]),
stretch as (select doc_id, p, min(i) as start, count(*) + p as length from met group by doc_id, p, island having count(*) + p >= greatest(24, 3 * p)),
run as (select doc_id, start, length, min(p) as period from stretch group by doc_id, start, length),
best as (select *, row_number() over (partition by doc_id order by length::decimal(38, 18) / period desc, start, period) as k from run),
told as (select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as t from run group by doc_id),
gone as (select distinct doc_id, unnest(range(start + period, start + length)) as i from run),
kept as (select doc_id, string_agg(x, ' ' order by i) as t from (select doc_id, unnest(w) as x, unnest(range(0, n)) as i from doc) anti join gone using (doc_id, i) group by doc_id)
select d.doc_id, coalesce(n_runs, 0) as n_runs, start, length, period, 1000 * length // period as exponent_milli, sha256(coalesce(t.t, '')) as runs_sha256, sha256(coalesce(k.t, '')) as collapsed_sha256, n as n_words
from doc d left join told t on d.doc_id = t.doc_id left join (from best where k = 1) b on d.doc_id = b.doc_id left join kept k on d.doc_id = k.doc_id
"""


def planted_periods(docs: DataFrame) -> DataFrame:
    """A tenth of the documents, by the checksum of the id, with the words from one place on replaced by a repetition of the first of them."""
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = docs.withColumn("_h", F.when(h % 10 == 0, F.floor(h / 10))).withColumn("_w", F.when(F.col("_h").isNotNull(), F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")))
    n = F.size("_w").cast("long")
    chosen = chosen.withColumn("_n", n).withColumn("_a", F.when(F.col("_n") > 0, F.col("_h") % F.col("_n")))
    chosen = chosen.withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_h") % 8)))
    place = lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p"))
    words = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1), lambda i: F.get("_w", place(i).cast("int")))
    text = F.when(F.col("_a").isNotNull(), F.array_join(words, " ")).otherwise(F.col("text"))
    return chosen.withColumn("text", text).drop("_h", "_w", "_n", "_a", "_p")


@query("op11_periodic_runs", _RUNS_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    out = runs.collapse_runs(planted_periods(docs))
    r = lambda best, run: F.when(run["length"] * best["period"] > best["length"] * run["period"], run).otherwise(best)
    best = F.when(F.size("runs") > 0, F.aggregate("runs", F.get("runs", F.lit(0)), r))
    out = out.withColumn("best", best)
    lines = F.array_join(F.transform("runs", lambda x: F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string"))), "\n")
    told = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(told, 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
        "n_words",
    )


@query("op12_token_files")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    ids = cut_lineage(idfiles.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, counts="counts", packed=True).drop("text"))
    target = f"{checkpoint_folder(spark)}/texelmill/{uuid.uuid4().hex}"
    idfiles.write_ids(ids, target, counts="counts")
    return idfiles.read_checksums(spark, target)


def _manifest_sql(levels: int = 7) -> str:
    """Trees unrolled to ``levels`` levels above the leaves, enough for 8 ** levels rows of a language."""
    field = lambda c: f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"
    leaf = lambda text: f"sha256({' || '.join(field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"
    crc = f"xor({_CRC_SQL.replace('d::varchar', 'doc_id::varchar')}, 4294967295)"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = f"""with raw as (select doc_id, lang, {leaf('text')} as leaf, case when {crc} % 3 = 0 then {leaf(lower)} else {leaf('text')} end as shown from documents),
    leaf as (select *, row_number() over (partition by lang order by doc_id nulls first) - 1 as i from raw),
    a0 as (select lang, i, leaf as d from leaf)"""
    for tree, key in (("a", "lang"), ("b", "k")):
        if tree == "b":
            out += f""", sub as (select lang, d as subroot, row_number() over (order by lang is not null, encode(lang)) - 1 as i from (select *, row_number() over (partition by lang order by level desc) as r
              from ({" union all ".join(f"select lang, d, {k} as level from a{k}" for k in range(levels + 1))})) where r = 1), b0 as (select 0 as k, i, subroot as d from sub)"""
        for k in range(1, levels + 1):
            out += f""", {tree}{k} as (select {key}, i // 8 as i, sha256(string_agg(d, '' order by i)) as d
              from (select *, count(*) over (partition by {key}) as n from {tree}{k - 1}) where n > 1 group by {key}, i // 8)"""
    out += f""", top as (select d as root from ({" union all ".join(f"select d, {k} as level from b{k}" for k in range(levels + 1))}) order by level desc limit 1),
    s0 as (select l.lang, l.i, doc_id, leaf, subroot, s.i as place, shown as f, '' as proof from leaf l join sub s on l.lang is not distinct from s.lang)"""
    step = 0
    for tree, key, own in (("a", "lang", "i"), ("b", "0", "place")):
        for k in range(1, levels + 1):
            many = f"(select {'lang' if tree == 'a' else 'k'} as lang from {tree}{k - 1} group by 1 having count(*) > 1)"
            node = f"select n.lang, run, ds from (select {'lang' if tree == 'a' else 'k as lang'}, i // 8 as run, list(d order by i) as ds from {tree}{k - 1} group by all) n join {many} m on n.lang is not distinct from m.lang"
            at = f"({own} // {8 ** (k - 1)}) % 8"
            left, right = f"coalesce(list_aggregate(ds[1:{at}], 'string_agg', ''), '')", f"coalesce(list_aggregate(ds[{at} + 2:], 'string_agg', ''), '')"
            out += f""", s{step + 1} as (select s.lang, i, doc_id, leaf, subroot, place, case when ds is null then f else sha256({left} || f || {right}) end as f,
              case when ds is null then proof else proof || {left} || {right} end as proof from s{step} s left join ({node}) r on {'s.lang is not distinct from r.lang' if tree == 'a' else 'true'} and run = {own} // {8 ** k})"""
            step += 1
    return out + f" select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, f as folded_root, f = root as verified from s{step}, top"


@query("op13_merkle_manifest", _manifest_sql())
def op13(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    leaf = lambda text: manifest.leaf_digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], text)
    shown = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, leaf(F.translate("text", upper, upper.lower())))
    out = manifest.dataset_manifest(docs, leaf(F.col("text")), "lang", "doc_id", {"shown": shown})
    proof = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    out = out.withColumn("folded_root", manifest.fold(F.coalesce("shown", "leaf"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
