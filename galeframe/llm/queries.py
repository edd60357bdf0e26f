"""The queries of the operators, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe.llm import chat, decontaminate, extract, jaccard, lines, lm, manifest, mixing, private, quality, substrings, urls, variants
from galeframe.llm.common import read


#: Target weights of the mixture, the others 1: the two first sources count more than the others.
WEIGHTS = {"src0": 3.0, "src1": 2.0}
#: Weights that aren't whole.
FRACTIONS = {"src0": 0.75, "src1": 0.5, "src2": 2.5}


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), WEIGHTS)


def op1_exact_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with weights that aren't whole numbers."""
    return mixing.mix(read(spark, sf_dir, "documents"), FRACTIONS)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def op2_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op2_quality_rules: statistics and base rules."""
    return quality.judge(read(spark, sf_dir, "documents"), None).select("doc_id", *quality.BASE, "base_failed")


def op3_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2 k and 2 k + 1 are the chosen and the rejected one of pair k."""
    conv = F.col("conv_id")
    pairs = chat.preference_pairs(read(spark, sf_dir, "conversations"), F.floor(conv / 2).cast("long"), F.pmod(conv, F.lit(2)) == 0)
    return pairs.withColumns({c: chat.mask_text(c) for c in ("chosen_mask", "rejected_mask")})


def op4_line_dedup(spark: SparkSession, sf_dir: str, window: int = 2) -> DataFrame:
    kept = lines.dedup_lines(read(spark, sf_dir, "documents"), window)
    return kept.select("doc_id", "n_lines", "n_deleted", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op4_single_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every later repeated line goes, where op4_line_dedup and its SQL delete only runs of two lines or more."""
    return op4_line_dedup(spark, sf_dir, window=1)


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is that of the document that it shows, whose number the URL's path has."""
    pages = read(spark, sf_dir, "pages")
    return urls.judge(pages, urls.mine(pages, read(spark, sf_dir, "labels"), urls.document_of(F.col("url"))))


def op5_listed_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op5_url_filters: host, path and listed rule."""
    return op5_url_filters(spark, sf_dir).select("page_id", "host", "path", "rule")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "set_id", "class_id", "n_links")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(read(spark, sf_dir, "pages"), extract.default_model())


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score(read(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", "n_pair_hits", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of five letters that occur three times, after one letter was lost in one of 97 pairs of document and word."""
    words = variants.word_counts(read(spark, sf_dir, "documents"), change=variants.typo).where("n >= 3")
    return variants.spelling_variants(words)


def op12_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = private.find(read(spark, sf_dir, "documents").select("doc_id", "text"))
    plain = F.filter("spans", lambda s: s["plain"])
    count = lambda k: F.size(F.filter(plain, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, private.KINDS), F.sha2(private.told(plain).cast("binary"), 256).alias("base_sha256"), private.told(F.col("spans")).alias("spans"))


def op12_plain_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op12_private_data: the spans without a disguise."""
    return op12_private_data(spark, sf_dir).drop("spans")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The holders of some rows claim one character more than the row has."""
    wrong = F.coalesce(F.try_add("n_chars", F.lit(1).cast("long")), F.col("n_chars"))
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    fields = [F.when(tampered, wrong).otherwise(F.col(c)) if c == "n_chars" else F.col(c) for c in manifest.FIELDS]
    got = manifest.verify(manifest.manifest(read(spark, sf_dir, "documents"), claimed=manifest.leaf(*fields)))
    return got.select("doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mixing": op1_source_mixing,
    "op1_exact_mixing": op1_exact_mixing,
    "op2_quality_rules": op2_quality_rules,
    "op2_statistics": op2_statistics,
    "op3_chat_preferences": op3_chat_preferences,
    "op4_line_dedup": op4_line_dedup,
    "op4_single_lines": op4_single_lines,
    "op5_url_filters": op5_url_filters,
    "op5_listed_rules": op5_listed_rules,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_html_extraction": op7_html_extraction,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_decontamination": op10_decontamination,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_private_data": op12_private_data,
    "op12_plain_spans": op12_plain_spans,
    "op13_merkle_manifest": op13_merkle_manifest,
}



def _mixing(weight: str) -> str:
    """Slot by slot: of the blocks that are released and not placed yet, the one with the earliest deadline."""
    return f"""
with recursive d as (select doc_id, coalesce(source, '') source, row_number() over (partition by coalesce(source, '') order by md5(coalesce(cast(doc_id as varchar), '')), doc_id) - 1 r from documents),
c as (select source, cast(ceil(count(*) / 64) as bigint) blocks, {weight} w from d group by source),
b as (select source, w, unnest(range(blocks)) j from c),
f as (select b.source, b.w, b.j, cast(sum(least(c.blocks * b.w, c.w * b.j)) // b.w as bigint) release_at, cast((sum(least(c.blocks * b.w, c.w * (b.j + 1))) + b.w - 1) // b.w as bigint) due from b, c group by b.source, b.w, b.j),
o as (select *, row_number() over (order by due, w, j, md5(source), source) k from f),
sim as (select cast(0 as bigint) t, cast([] as bigint[]) done
  union all select any_value(t) + 1, list_append(any_value(done), min(k)) from sim join o on release_at <= t and not list_contains(done, k) having count(*) > 0),
s as (select unnest(done) k, unnest(range(len(done))) slot from (select done from sim order by t desc limit 1))
select doc_id, d.source, cast(r // 64 as bigint) block, slot, release_at as release, due as deadline, cast(r % 64 as bigint) in_block
from d join o on o.source = d.source and o.j = d.r // 64 join s using (k)"""


#: The CRC-32 of a string's bytes, as SQL beside the one row of crc_table.
CRC = "xor(list_reduce(list_transform(range(1, strlen({0}) * 2, 2), lambda i: cast('0x' || substr(hex({0}), i, 2) as bigint)), lambda c, b: xor(c >> 8, v[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"
CRC_TABLE = "crc_table as (select list(list_reduce([8, 7, 6, 5, 4, 3, 2, 1], lambda c, b: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k) order by k) v from range(256) r(k))"

ORACLES: dict[str, str] = {
    "op1_source_mixing": _mixing("case source when 'src0' then 3 when 'src1' then 2 else 1 end"),
    "op1_exact_mixing": _mixing("case source when 'src0' then 3 when 'src1' then 2 when 'src2' then 10 else 4 end"),
    "op2_statistics": r"""
with d as (select row_number() over () rid, doc_id, coalesce(text, '') text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
l as (select rid, unnest(string_split(text, chr(10))) x from d),
dup as (select rid, count(*) - count(distinct x) n from l where regexp_matches(x, '[^\x20\x09-\x0D]') group by rid),
win as (select rid, i, array_to_string(w[i:i + 7], ' ') s from (select rid, w, unnest(range(1, len(w) - 6)) i from d where len(w) >= 8)),
rep as (select rid, i, count(*) over (partition by rid, s) c from win),
again as (select rid, count(distinct p) n from (select rid, unnest(range(i, i + 8)) p from rep where c > 1) group by rid)
select doc_id, cast(len(w) as bigint) n_words, cast(length(array_to_string(w, '')) as bigint) word_chars, cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) n_symbols,
  cast(coalesce(dup.n, 0) as bigint) n_dup_lines, cast(coalesce(again.n, 0) as bigint) n_repeat_words, len(w) < 20 or 100 * coalesce(again.n, 0) > 30 * len(w) base_failed
from d left join dup using (rid) left join again using (rid)""",
    "op5_listed_rules": r"""
with p as (select page_id, coalesce(regexp_extract(url, '://([^/?#]*)', 1), '') h, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') path from pages),
q as (select page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, path from p),
r as (select unnest(['org', 'example.org', 'example.org', 'com', 'com']) rh, unnest(['/', '/es/', '/en/1', '/fr/', '/de/']) rp)
select page_id, host, path, (select arg_max(rh || rp, length(rh || rp)) from r where (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp)) as rule from q""",
    "op6_ngram_jaccard": r"""
with recursive d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
s as (select doc_id, case when len(w) < 5 then case when len(w) = 0 then [] else [array_to_string(w, ' ')] end else list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) end z from d),
c as (select z, min(doc_id) set_id, len(z) n from s where len(z) > 0 group by z),
g as (select set_id, n, unnest(z) x from c),
pairs as (select a.set_id a, b.set_id b, any_value(a.n) na, any_value(b.n) nb, count(*) k from g a join g b on a.x = b.x and a.set_id < b.set_id group by 1, 2),
one as (select a, b from pairs where 9 * k >= 4 * (na + nb)),
links as (select a, b from one union all select b, a from one),
reach as (select set_id a, set_id b from c union select reach.a, links.b from reach join links on links.a = reach.b),
class as (select a set_id, min(b) class_id from reach group by 1),
degree as (select a set_id, count(*) k from links group by 1)
select doc_id, cast(len(s.z) as bigint) n_shingles, coalesce(c.set_id, doc_id) set_id, coalesce(class_id, doc_id) class_id, cast(coalesce(k, 0) as bigint) n_links
from s left join c on s.z = c.z left join class using (set_id) left join degree using (set_id)""",
    "op3_chat_preferences": r"""
with t as (select distinct conv_id, turn, coalesce(role, 'user') role, coalesce(text, '') text from conversations where conv_id is not null),
l as (select conv_id, list({'r': role, 't': text} order by turn nulls first, role, text) x from t group by conv_id),
p as (select cast(floor(conv_id / 2) as bigint) pair_id, min(case when conv_id % 2 = 0 then conv_id end) chosen_id, min(case when conv_id % 2 <> 0 then conv_id end) rejected_id from l group by 1),
j as (select pair_id, chosen_id, rejected_id, coalesce(a.x, []) a, coalesce(b.x, []) b from p left join l a on a.conv_id = chosen_id left join l b on b.conv_id = rejected_id),
n as (select *, coalesce((select min(i) - 1 from range(1, least(len(a), len(b)) + 1) r(i) where a[i] <> b[i]), least(len(a), len(b))) n from j),
f as (select unnest([1, 2, 3]) part),
e as (select pair_id, part, unnest(range(1, len(y) + 1)) i, y from (select pair_id, part, case part when 1 then a[1:n] when 2 then a[n + 1:] else b[n + 1:] end y from n, f)),
s as (select pair_id, part, i, y[i].r r, '<|im_start|>' || y[i].r || chr(10) h, y[i].t || '<|im_end|>' || chr(10) t from e),
o as (select pair_id, part, string_agg(h || t, '' order by i) txt, string_agg(case when r = 'assistant' then (a + length(h)) || '-' || (a + length(h) + length(t)) end, ',' order by i) mask
  from (select *, coalesce(sum(length(h) + length(t)) over (partition by pair_id, part order by i rows between unbounded preceding and 1 preceding), 0) a from s) group by pair_id, part)
select pair_id, chosen_id, rejected_id, cast(n as integer) n_common, coalesce(x.txt, '') prompt, case when chosen_id is not null then coalesce(y.txt, '') end chosen, case when chosen_id is not null then coalesce(y.mask, '') end chosen_mask,
  case when rejected_id is not null then coalesce(z.txt, '') end rejected, case when rejected_id is not null then coalesce(z.mask, '') end rejected_mask
from n left join (from o where part = 1) x using (pair_id) left join (from o where part = 2) y using (pair_id) left join (from o where part = 3) z using (pair_id)""",
    "op4_line_dedup": r"""
with d as (select row_number() over () rid, doc_id, coalesce(text, '') text, string_split(text, chr(10)) l from documents),
e as (select rid, doc_id, p - 1 p, l[p] x from (select rid, doc_id, l, unnest(range(1, len(l) + 1)) p from d) where regexp_matches(l[p], '[^\x20\x09-\x0D]')),
w as (select rid, doc_id, p, x, lead(p) over o q, lead(x) over o y from e window o as (partition by rid order by p)),
f as (select *, row_number() over (partition by x, y order by doc_id, rid, p) k from w where q is not null),
gone as (select distinct rid, unnest([p, q]) p from f where k > 1),
kept as (select rid, string_agg(x, chr(10) order by p) t from (select rid, p - 1 p, l[p] x from (select rid, l, unnest(range(1, len(l) + 1)) p from d)) anti join gone using (rid, p) group by rid),
g as (select rid, count(*) n from gone group by rid)
select doc_id, cast(coalesce(len(l), 0) as bigint) n_lines, cast(coalesce(n, 0) as bigint) n_deleted, sha256(coalesce(t, '')) kept_sha256 from d left join kept using (rid) left join g using (rid)""",
    "op4_single_lines": r"""
with d as (select row_number() over () rid, doc_id, coalesce(text, '') text, string_split(text, chr(10)) l from documents),
e as (select rid, doc_id, p - 1 p, l[p] x from (select rid, doc_id, l, unnest(range(1, len(l) + 1)) p from d)),
f as (select *, row_number() over (partition by x order by doc_id, rid, p) k from e where regexp_matches(x, '[^\x20\x09-\x0D]')),
gone as (select rid, p from f where k > 1),
kept as (select rid, string_agg(x, chr(10) order by p) t from e anti join gone using (rid, p) group by rid),
g as (select rid, count(*) n from gone group by rid)
select doc_id, cast(coalesce(len(l), 0) as bigint) n_lines, cast(coalesce(n, 0) as bigint) n_deleted, sha256(coalesce(t, '')) kept_sha256 from d left join kept using (rid) left join g using (rid)""",
    "op8_lm_scoring": r"""
with d as (select row_number() over () rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
t as (select rid, i, w[i] x, case when i > 1 then w[i - 1] end p from (select rid, w, unnest(range(1, len(w) + 1)) i from d)),
u as (select x, count(*) c from t group by x), b as (select p, x, count(*) c from t where p is not null group by p, x),
s as (select t.rid, b.c >= 2 hit, case when t.p is null then ln(u.c / (select count(*) from t)) else ln(b.c / up.c) end s
  from t join u on t.x = u.x left join b on t.p = b.p and t.x = b.x left join u up on t.p = up.x),
g as (select rid, count(*) n, count(*) filter (where hit) h, sum(s) s from s group by rid)
select doc_id, cast(coalesce(n, 0) as bigint) n_words, cast(coalesce(h, 0) as bigint) n_pair_hits, round(s, 4) log_score, round(s / n, 6) mean_log_score from d left join g using (rid)""",
    "op11_spelling_variants": rf"""
with recursive {CRC_TABLE},
t as (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) x from documents),
g as (select coalesce(cast(doc_id as varchar), '') || ':' || w k, w, count(*) c from (select doc_id, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') w from t) group by all),
h as (select w, c, {CRC.format("k")} h from g, crc_table),
z as (select case when h % 97 = 0 then substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) else w end w, sum(c) n from h group by 1),
v as (select w, cast(n as bigint) n from z where length(w) >= 5 and n >= 3),
u as (select w, n, i, substr(w, 1, i - 1) || substr(w, i + 1) r from (select w, n, unnest(range(1, length(w) + 1)) i from v)),
p as (select a.w, b.w o, b.n m from u a join u b on a.r = b.r and a.i = b.i and a.w <> b.w union select a.w, b.w, b.n from v a join u b on a.w = b.r union select b.w, a.w, a.n from v a join u b on a.w = b.r),
s as (select w, count(*) k, first(o order by m desc, o) o, max(m) m from p group by w),
f as (select v.w, v.n, coalesce(k, 0) n_near, case when m >= 2 * n then o end form, case when m >= 2 * n then m end form_n from v left join s using (w)),
e as (select w, form y, 1 i from f where form is not null union all select e.w, f.form, i + 1 from e join f on f.w = e.y where f.form is not null)
select w word, form, coalesce((select arg_max(y, i) from e where e.w = f.w), w) root, n, n_near, form_n from f""",
    "op12_plain_spans": r"""
with d as (select row_number() over () rid, doc_id, translate(coalesce(text, ''), chr(1) || chr(2), chr(3) || chr(3)) t from documents),
x as (select rid, 1 o, 'email' kind, regexp_replace(t, '([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+)', chr(1) || '\1' || chr(2), 'g') y from d
  union all select rid, 2, 'ip', regexp_replace(t, '([0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+))', chr(1) || '\1' || chr(2), 'g') from d
  union all select rid, 3, 'card', regexp_replace(t, '([0-9]([\x20-]?[0-9])+)', chr(1) || '\1' || chr(2), 'g') from d
  union all select rid, 4, 'phone', regexp_replace(t, '(\+[0-9][\x20().0-9-]+[0-9])', chr(1) || '\1' || chr(2), 'g') from d),
p as (select rid, o, kind, string_split(y, chr(1)) x from x),
m as (select rid, o, kind, string_split(x[i], chr(2))[1] v, cast(list_sum(list_transform(x[1:i - 1], lambda z: length(replace(z, chr(2), '')))) as bigint) a from (select *, unnest(range(2, len(x) + 1)) i from p)),
g as (select *, reverse(regexp_replace(v, '[^0-9]', '', 'g')) g, list_transform(string_split(v, '.'), lambda z: ltrim(z, '0')) q from m),
c as (select rid, o, kind, a, a + length(v) b from g where case kind when 'email' then true
  when 'ip' then list_max(list_transform(q, lambda z: case when length(z) > 3 then 999 when z = '' then 0 else cast(z as int) end)) <= 255
  when 'phone' then length(g) between 10 and 15
  else length(g) between 14 and 19 and list_sum(list_transform(range(1, length(g) + 1), lambda i: case when i % 2 = 1 then cast(substr(g, i, 1) as int) else (2 * cast(substr(g, i, 1) as int)) % 10 + (2 * cast(substr(g, i, 1) as int)) // 10 end)) % 10 = 0 end),
s as (select rid, count(*) filter (where o = 1) n_email, count(*) filter (where o = 2) n_ip, count(*) filter (where o = 3) n_card, count(*) filter (where o = 4) n_phone, string_agg(kind || ':' || a || ':' || b, ',' order by a, o) t from c group by rid)
select doc_id, coalesce(n_email, 0) n_email, coalesce(n_ip, 0) n_ip, coalesce(n_card, 0) n_card, coalesce(n_phone, 0) n_phone, sha256(coalesce(s.t, '')) base_sha256 from d left join s using (rid)""",
    "op13_merkle_manifest": rf"""
with recursive {CRC_TABLE},
d as (select doc_id, lang, coalesce(strlen(cast(doc_id as varchar)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') a, n_chars c, coalesce(strlen(text) || ':' || text, '-') z,
  coalesce({CRC.format("cast(doc_id as varchar)")} % 7 = 0, false) bad from documents, crc_table),
e as (select doc_id, lang, bad, sha256(a || coalesce(strlen(cast(c as varchar)) || ':' || c, '-') || z) leaf, sha256(a || coalesce(strlen(cast(c + 1 as varchar)) || ':' || (c + 1), '-') || z) wrong from d),
l as (select *, dense_rank() over (order by lang nulls first) tree, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 idx, count(*) over (partition by lang) n from e),
up as (select tree, 0 lvl, idx, n, leaf digest from l union all select tree, lvl + 1, idx // 2, (n + 1) // 2, sha256(string_agg(digest, '' order by idx)) from up where n > 1 group by tree, lvl, idx // 2, n),
sub as (select tree, lvl depth, digest, max(tree) over () m from up where n = 1),
top as (select 0 lvl, tree - 1 idx, m n, digest from sub union all select lvl + 1, idx // 2, (n + 1) // 2, sha256(string_agg(digest, '' order by idx)) from top where n > 1 group by lvl, idx // 2, n),
step as (select doc_id, leaf, wrong, bad, l.tree, g.lvl s, (l.idx >> g.lvl) & 1 side, (select digest from up u where u.tree = l.tree and u.lvl = g.lvl and u.idx = xor(l.idx >> g.lvl, 1)) sib from l, sub, range(0, 64) g(lvl) where sub.tree = l.tree and g.lvl < depth
  union all select doc_id, leaf, wrong, bad, l.tree, depth + g.lvl, ((l.tree - 1) >> g.lvl) & 1, (select digest from top u where u.lvl = g.lvl and u.idx = xor((l.tree - 1) >> g.lvl, 1)) from l, sub, range(0, 64) g(lvl) where sub.tree = l.tree and g.lvl < (select max(lvl) from top)),
key as (select row_number() over () k, * from l),
walk as (select k, key.leaf, s, side, sib from key join step on key.leaf = step.leaf and key.tree = step.tree and key.doc_id is not distinct from step.doc_id qualify row_number() over (partition by k, s) = 1),
fold as (select k, 0 s, case when bad then wrong else leaf end h from key
  union all select k, fold.s + 1, sha256(case when side = 1 then coalesce(sib, '') || h else h || coalesce(sib, '') end) from fold join walk using (k, s)),
done as (select k, arg_max(h, s) folded_root from fold group by k),
proof as (select k, sha256(coalesce(string_agg(sib, '' order by s), '')) proof_sha256 from walk group by k)
select doc_id, leaf, sub.digest subroot, top.digest root, coalesce(proof_sha256, sha256('')) proof_sha256, folded_root, folded_root = top.digest verified
from top join key on top.n = 1 join sub using (tree) join done using (k) left join proof using (k)""",
    "op9_substring_dedup": r"""
with d as (select row_number() over () rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
win as (select rid, i, md5(array_to_string(w[i:i + 34], ' ')) s from (select rid, w, unnest(range(1, len(w) - 33)) i from d where len(w) >= 35)),
rep as (select s from win group by s having count(*) > 1),
gone as (select distinct rid, unnest(range(i, i + 35)) p from win where s in (select s from rep)),
kept as (select rid, string_agg(x, ' ' order by p) k, count(*) n from (select rid, p, w[p] x from (select rid, w, unnest(range(1, len(w) + 1)) p from d) anti join gone using (rid, p)) group by rid)
select doc_id, cast(len(w) as bigint) n_words, cast(len(w) - coalesce(n, 0) as bigint) n_removed, sha256(coalesce(k, '')) kept_sha256 from d left join kept using (rid)""",
    "op10_decontamination": r"""
with d as (select doc_id, row_number() over () rid, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\x00', ' ', 'g'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select cast(item_id as varchar) item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
bw as (select distinct item, k, array_to_string(w[i:i + k - 1], ' ') s from (select item, w, least(len(w), 13) k, unnest(range(1, len(w) - least(len(w), 13) + 2)) i from b where len(w) > 0)),
ks as (select distinct k from bw),
dw as (select rid, i, k, array_to_string(w[i:i + k - 1], ' ') s from (select rid, w, k, unnest(range(1, len(w) - k + 2)) i from d cross join ks where len(w) >= k)),
hits as (select rid, i, dw.k k, item from dw join bw on dw.k = bw.k and dw.s = bw.s),
n as (select rid, count(distinct p) n_hit from (select rid, unnest(range(i, i + k)) p from hits) group by rid),
its as (select rid, count(distinct item) n_items, string_agg(distinct item, ',' order by item) items from hits group by rid)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items, sha256(coalesce(items, '')) items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join n using (rid) left join its using (rid)""",
}
