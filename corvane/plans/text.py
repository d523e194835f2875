"""Queries over free text: sections, cleaning, reports, tags, phrases, conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.session import load

_WORDS = r"list_filter(regexp_split_to_array({}, '[ \t-\r]+'), lambda w: w <> '')"
NOTES = ("thth", "ouen")


def q02_section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with a word as a section: its number and length."""
    lines = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.where(F.length(F.trim("line")) > 0).select("doc_id", "pos", F.length("line").alias("n_chars"))


def q03_section_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types as section headers, normalised by alias, contained word and view phrase, counted."""
    aliases = {"economy": "impression", "promo": "findings of promotion"}
    parts = load(spark, sf_dir, "part").select(X.section_name(F.concat_ws(" ", "p_type", F.when(F.col("p_size") > 40, "one view")), aliases).alias("name"))
    return parts.groupBy("name").agg(F.count("*").alias("n"))


def q04_sentence_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut before its first noted sentence; emptied ones left out."""
    cut = X.cut_at_note(F.col("text"), NOTES)
    return load(spark, sf_dir, "documents").select("doc_id", cut.alias("kept")).where(X.n_words(F.col("kept")) >= 2).select("doc_id", F.length("kept").alias("n_chars"), F.md5("kept").alias("digest"))


def q05_caption_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts and part names as captions."""
    texts = load(spark, sf_dir, "benchmark").select("text").union(load(spark, sf_dir, "part").select(F.concat(F.lit("  "), "p_name", F.lit(" ")).alias("text")))
    return texts.select(X.caption(F.col("text")).alias("caption")).where("caption is not null").groupBy("caption").agg(F.count("*").alias("n"))


def q06_report_assemble_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last lines of documents assembled to reports and taken apart again."""
    lines = F.split("text", "\n")
    docs = load(spark, sf_dir, "documents").select("doc_id", F.element_at(lines, 1).alias("f"), F.when(F.size(lines) > 1, F.element_at(lines, -1)).alias("i"))
    made = docs.select("doc_id", X.report(F.col("f"), F.col("i")).alias("report"))
    return made.select("doc_id", F.md5("report").alias("digest"), F.length(X.report_part(F.col("report"), "findings")).alias("n_findings"), F.length(X.report_part(F.col("report"), "impression")).alias("n_impression"))


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts with their second and fifth word tagged."""
    w = F.split("text", " ")
    tag = lambda k, target: F.concat(F.lit("["), F.element_at("w", k), F.lit(f"]({target})"))
    items = load(spark, sf_dir, "benchmark").select("item_id", w.alias("w")).where("size(w) >= 6")
    return items.select("item_id", F.concat(F.element_at("w", 1), F.lit(" "), tag(2, " heart "), F.lit(" "), F.array_join(F.slice("w", 3, 2), " "), F.lit(" "), tag(5, "lung"), F.lit(" "), F.array_join(F.slice("w", 6, F.size("w")), " ")).alias("tagged"))


def q07_tag_extract_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tags of every tagged text with their places; each phrase is what stands there."""
    tags = _tagged(spark, sf_dir).select("item_id", X.untagged(F.col("tagged")).alias("plain"), F.posexplode(X.tags(F.col("tagged"))).alias("no", "t"))
    return tags.select("item_id", "no", "t.phrase", "t.target", "t.start", "t.end", (F.substring("plain", F.col("t.start") + 1, F.col("t.end") - F.col("t.start")) == F.col("t.phrase")).alias("stands"))


def q08_strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases marked with <p>, taken out and stripped."""
    made = F.concat(F.lit("x <p>"), "p_name", F.lit("</p> y <p>"), "p_brand", F.lit("</p>"))
    parts = load(spark, sf_dir, "part").select("p_partkey", made.alias("m"))
    return parts.select("p_partkey", F.array_join(X.phrases(F.col("m")), "|").alias("phrases"), X.stripped(F.col("m")).alias("plain"), X.paired(F.col("m")).alias("paired"))


def _synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = load(spark, sf_dir, "part").where("p_partkey % 3 <> 0").select(X.phrase_key(F.concat(F.lit("The "), "p_name", F.lit("s"))).alias("key")).distinct()
    return names.where(~F.endswith("key", F.lit("widget"))).withColumn("target", F.concat(F.lit("t:"), "key"))


def q09_phrase_normalize_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names looked up by normal form among synonyms, with how many rows each target gets."""
    phrases = load(spark, sf_dir, "part").select(X.phrase_key(F.upper("p_name")).alias("key"))
    return phrases.join(_synonyms(spark, sf_dir), "key").groupBy("target").agg(F.count("*").alias("n"))


def q19_synonym_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names whose normal form no synonym has."""
    phrases = load(spark, sf_dir, "part").select(X.phrase_key(F.col("p_name")).alias("key"))
    return phrases.join(_synonyms(spark, sf_dir), "key", "left_anti").groupBy("key").agg(F.count("*").alias("n"))


def q10_span_inject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag spans put back into the plain texts as <p> marks."""
    rows = _tagged(spark, sf_dir).select("item_id", X.untagged(F.col("tagged")).alias("plain"), X.tags(F.col("tagged")).alias("tags"))
    return rows.select("item_id", X.marked(F.col("plain"), F.col("tags")).alias("marked"))


def q11_natural_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The priorities of every customer's orders as a spoken list, by list."""
    lists = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderstatus")).alias("s"))
    return lists.select(X.listed(F.col("s")).alias("said")).groupBy("said").agg(F.count("*").alias("n"))


def q12_score_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores read from judge answers; answers without one count 0."""
    said = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Analysis: ok Score: "), F.col("value").cast("decimal(10,2)").cast("string"), F.lit("."))).otherwise("no score")
    return load(spark, sf_dir, "events").select("event_type", X.score_of(said).alias("score")).groupBy("event_type").agg(F.round(F.avg("score"), 4).alias("score"), F.count("*").alias("n"))


def q13_keyword_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that hold a keyword are rewritten, others pass as they are, each in its place."""
    text = F.col("text")
    out = F.when(X.mentions(text, ("with", "from")), F.concat(F.lit("R:"), F.lower(text))).otherwise(text)
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(out).alias("digest"))


def q14_structural_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports that have both sections, against all, by source."""
    lines = F.split("text", "\n")
    made = F.concat(F.lit("Findings: "), F.element_at(lines, 1), F.lit(" Impression: "), F.when(F.size(lines) > 2, F.element_at(lines, 2)).otherwise(""))
    docs = load(spark, sf_dir, "documents").select("source", X.well_formed(made).alias("ok"))
    return docs.groupBy("source").agg(F.count("*").alias("before"), F.sum(F.col("ok").cast("long")).alias("after"))


def q15_lang_nonblank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents with text, kept as pairs, by source."""
    docs = load(spark, sf_dir, "documents").where((F.col("lang") == "en") & ~X.blank(F.col("text")))
    return docs.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


def q33_last_section_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each conversation the last turn of the best role: assistant, else user, else system."""
    rank = F.when(F.col("role") == "assistant", 0).when(F.col("role") == "user", 1).otherwise(2)
    w = Window.partitionBy("conv_id").orderBy(rank, F.desc("turn"))
    rows = load(spark, sf_dir, "conversations").withColumn("r", F.row_number().over(w)).where("r = 1")
    return rows.select("conv_id", "role", "turn", F.md5("text").alias("digest"))


def q53_conversation_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question and answer pairs of every conversation: each user turn with the assistant turn after it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = load(spark, sf_dir, "conversations").withColumns({"next_role": F.lead("role").over(w), "next_text": F.lead("text").over(w)})
    pairs = turns.where("role = 'user' and next_role = 'assistant'")
    return pairs.select("conv_id", "turn", F.md5(F.concat(F.lit("Question: "), "text", F.lit(" Answer: "), "next_text")).alias("digest"))


def q65_results_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label rows as result sentences, counted."""
    pair = lambda name: F.struct(F.lit(name).alias("name"), (F.col(name) == 1).alias("positive"))
    rows = load(spark, sf_dir, "labels").select(X.results(F.array(pair("quality"), pair("toxic"))).alias("said"))
    return rows.groupBy("said").agg(F.count("*").alias("n"))


def q66_word_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in runs of 50 words that overlap by 10: how many, and how long the last one is."""
    runs = X.chunks_of_words(F.col("text"), 50, 10)
    return load(spark, sf_dir, "documents").select("doc_id", runs.alias("r")).select("doc_id", F.size("r").alias("n"), F.length(F.element_at("r", -1)).alias("last_chars"))


def q67_chat_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in the instruction style, hashed."""
    from corvane.operators.conversation import rendered

    turns = load(spark, sf_dir, "conversations")
    said = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return said.select("conv_id", F.md5(rendered(F.col("turns"), "llama_2")).alias("digest"))


QUERIES = {k: v for k, v in globals().items() if k[0] == "q" and k[1:3].isdigit()}

_TAGGED = """
w as (select item_id, string_split(text, ' ') w from benchmark),
g as (select item_id, w[1] || ' [' || w[2] || ']( heart ) ' || array_to_string(w[3:4], ' ') || ' [' || w[5] || '](lung) ' || array_to_string(w[6:], ' ') tagged,
             w[1] || ' ' || w[2] || ' ' || array_to_string(w[3:4], ' ') || ' ' || w[5] || ' ' || array_to_string(w[6:], ' ') plain,
             w, length(w[1]) + 1 s1, length(w[1]) + 1 + length(w[2]) + 1 + length(array_to_string(w[3:4], ' ')) + 1 s2 from w where len(w) >= 6)"""
_SINGULAR = r"""case when regexp_matches(x, '(?:ss|us|is)$') or length(x) <= 3 then x when regexp_matches(x, 'ies$') then regexp_replace(x, 'ies$', 'y')
 when regexp_matches(x, '(?:ch|sh|x|z|s)es$') then regexp_replace(x, 'es$', '') when regexp_matches(x, 's$') then regexp_replace(x, 's$', '') else x end"""
_KEY = "array_to_string(list_filter(list_transform(" + _WORDS.format("lower({})") + ", lambda x: " + _SINGULAR + "), lambda w: w <> 'the'), ' ')"
_SYNONYMS = "s as (select distinct " + _KEY.replace("{}", "'The ' || p_name || 's'") + " as k from part where p_partkey % 3 <> 0), t as (select k, 't:' || k target from s where not suffix(k, 'widget'))"

ORACLE_SQL = {
    "q67_chat_render": """with t as (select conv_id, turn, role, text, first_value(case when role = 'system' then text end ignore nulls) over (partition by conv_id order by turn, role, text rows between unbounded preceding and unbounded following) sys from conversations),
r as (select *, row_number() over (partition by conv_id order by turn, role, text) k from t where role <> 'system')
select c.conv_id, md5(coalesce(said, '')) digest from (select distinct conv_id from conversations) c left join (select conv_id, string_agg(case when role = 'user' then '<s>[INST] ' || case when k = 1 and sys is not null
 then '<<SYS>>' || chr(10) || sys || chr(10) || '<</SYS>>' || chr(10) || chr(10) else '' end || text || ' [/INST]' else ' ' || text || ' </s>' end, '' order by k) said from r group by 1) using (conv_id)""",
    "q02_section_split": "with l as (select doc_id, string_split(text, chr(10)) p from documents), e as (select doc_id, p, unnest(range(0, len(p))) pos from l) select doc_id, cast(pos as int) pos, cast(length(p[pos + 1]) as int) n_chars from e where length(trim(p[pos + 1], ' ')) > 0",
    "q03_section_alias": """with p as (select lower(trim(concat_ws(' ', p_type, case when p_size > 40 then 'one view' end), ' ')) k from part)
select case when k = 'economy' then 'impression' when k = 'promo' then 'findings of promotion' when contains(k, 'impression') then 'impression' when contains(k, 'findings') then 'findings'
 when contains(k, 'history') then 'history' when contains(k, 'comparison') then 'comparison' when contains(k, 'addendum') then 'addendum'
 when regexp_matches(k, 'chest|portable|pa and lat|two views|one view|frontal view|ap view|ribs') then 'findings' else k end as name, count(*) n from p group by 1""",
    "q04_sentence_truncate": f"""with d as (select doc_id, text, string_split(text, '.') parts from documents),
e as (select *, coalesce(list_position(list_transform(parts, lambda s: contains(s, 'thth') or contains(s, 'ouen')), true), 0) pos from d),
k as (select doc_id, case when pos = 0 then text when pos = 1 then '' else array_to_string(parts[1:pos-1], '.') || '.' end kept from e)
select doc_id, cast(length(kept) as int) n_chars, md5(kept) digest from k where len({_WORDS.format('kept')}) >= 2""",
    "q05_caption_norm": """with t as (select trim(text, ' ') t from benchmark union all select trim(p_name, ' ') from part),
c as (select translate(t[1], 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || t[2:] c from t where length(t) >= 10)
select case when suffix(c, '.') then c else c || '.' end caption, count(*) n from c group by 1""",
    "q06_report_assemble_parse": r"""with l as (select doc_id, string_split(text, chr(10)) p from documents),
m as (select doc_id, case when len(p) > 1 and length(trim(p[-1], ' ')) > 0 then 'Findings: ' || p[1] || chr(10) || 'Impression: ' || p[-1] else p[1] end r from l)
select doc_id, md5(r) digest, cast(length(trim(regexp_extract(r, '(?s)^.*?Findings:(.*?)Impression:(.*)$', 1), ' ')) as int) n_findings,
 cast(length(trim(regexp_extract(r, '(?s)^.*?Findings:(.*?)Impression:(.*)$', 2), ' ')) as int) n_impression from m""".replace("trim(regexp_extract", "trim(regexp_extract"),
    "q07_tag_extract_offsets": f"""with {_TAGGED}
select item_id, 0 no, w[2] phrase, 'heart' target, cast(s1 as int) start, cast(s1 + length(w[2]) as int) "end", substr(plain, s1 + 1, length(w[2])) = w[2] stands from g
union all select item_id, 1, w[5], 'lung', cast(s2 as int), cast(s2 + length(w[5]) as int), substr(plain, s2 + 1, length(w[5])) = w[5] from g""",
    "q08_strip_tags": "select p_partkey, p_name || '|' || p_brand phrases, 'x ' || p_name || ' y ' || p_brand plain, true paired from part",
    "q09_phrase_normalize_join": f"with {_SYNONYMS}, p as (select {_KEY.replace('{}', 'upper(p_name)')} k from part) select target, count(*) n from p join t using (k) group by target",
    "q19_synonym_anti": f"with {_SYNONYMS}, p as (select {_KEY.replace('{}', 'p_name')} k from part) select p.k as key, count(*) n from p where not exists (select 1 from t where t.k = p.k) group by p.k",
    "q10_span_inject": f"""with {_TAGGED}
select item_id, case when s1 > 1 then w[1] || '<p> ' else w[1] || ' <p>' end || w[2] || '</p> ' || array_to_string(w[3:4], ' ') || '<p> ' || w[5] || '</p> ' || array_to_string(w[6:], ' ') marked from g""",
    "q11_natural_join": """with l as (select o_custkey, list_sort(list(distinct o_orderstatus)) s from orders group by 1)
select case when len(s) = 1 then s[1] when len(s) = 2 then s[1] || ' and ' || s[2] else array_to_string(s[1:len(s)-1], ', ') || ', and ' || s[len(s)] end said, count(*) n from l group by 1""",
    "q12_score_parse": "select event_type, round(avg(case when event_id % 3 = 0 then cast(cast(value as decimal(10,2)) as double) else 0.0 end), 4) score, count(*) n from events group by 1",
    "q13_keyword_conditional": "select doc_id, md5(case when contains(lower(text), 'with') or contains(lower(text), 'from') then 'R:' || lower(text) else text end) digest from documents",
    "q14_structural_validity": """with l as (select source, string_split(text, chr(10)) p from documents)
select source, count(*) before, cast(sum(case when length(trim(p[1], ' ')) > 0 and len(p) > 2 and length(trim(p[2], ' ')) > 0 then 1 else 0 end) as bigint) after from l group by 1""",
    "q15_lang_nonblank": "select source, count(*) n, cast(sum(n_chars) as bigint) n_chars from documents where lang = 'en' and length(trim(text, ' ')) > 0 group by 1",
    "q33_last_section_priority": """select conv_id, role, turn, md5(text) digest from (select *, row_number() over (partition by conv_id
 order by case role when 'assistant' then 0 when 'user' then 1 else 2 end, turn desc) r from conversations) where r = 1""",
    "q53_conversation_build": """select conv_id, turn, md5('Question: ' || text || ' Answer: ' || nt) digest from (select *, lead(role) over w nr, lead(text) over w nt from conversations
 window w as (partition by conv_id order by turn)) where role = 'user' and nr = 'assistant'""",
    "q65_results_text": "select 'Results: quality: ' || case when quality = 1 then 'yes' else 'no' end || ', toxic: ' || case when toxic = 1 then 'yes' else 'no' end || '.' said, count(*) n from labels group by 1",
    "q66_word_chunks": f"""with w as (select doc_id, {_WORDS.format('text')} w from documents), n as (select doc_id, w, greatest(ceil((len(w) - 10) / 40.0), 1)::int n from w)
select doc_id, n, cast(length(array_to_string(w[(n - 1) * 40 + 1:(n - 1) * 40 + 50], ' ')) as int) last_chars from n""",
}
