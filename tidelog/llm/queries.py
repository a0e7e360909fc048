"""The registered query of each operator over its whole table, and its DuckDB SQL where SQL can express it.

``PIECES`` and ``TOKENIZER`` name the public vocabulary files; their paths are parameters of the queries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import decontamination, language_id, license_scan, permutation_index, piece_sampling, simhash, token_counts, token_files, toxicity, url_filter

PIECES, TOKENIZER = "piece_bpe_32k.model", "word_bpe_49k.json"


def vocabulary(name: str) -> bytes:
    """The bytes of a public tokenizer's file; read on the driver and broadcast."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as source:
        return source.read()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: directories by source, thousand and hundred of the id."""
    path = F.concat_ws("/", "source", F.expr("doc_id div 1000"), F.expr("doc_id div 100 % 10"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    files = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text")
    return license_scan.license_scan(files)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_duplicates(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_token_files(token_files.write_token_files(table(spark, sf_dir, "documents"), vocabulary(TOKENIZER)))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.piece_digest(table(spark, sf_dir, "documents"), vocabulary(PIECES))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_predictions(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary(PIECES))


_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4_SQL = rf"""
with item as (select cast(item_id as varchar) item, regexp_extract_all({_ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark where item_id is not null),
sized as (select item, w, least(len(w), 13) k from item where len(w) > 0),
win as (select distinct item, k, array_to_string(w[i:i + k - 1], ' ') s from (select item, w, k, unnest(range(1, len(w) - k + 2)) i from sized)),
doc as (select doc_id, regexp_extract_all({_ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
place as (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) i from doc, (select distinct k from sized) where len(w) >= k),
hit as (select p.doc_id, p.i, p.k, win.item from (select doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') s from place) p join win on win.k = p.k and win.s = p.s),
hits as (select doc_id, count(distinct x) n_hit from (select doc_id, unnest(range(i, i + k)) x from hit) group by doc_id),
items as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) l from (select distinct doc_id, item from hit) group by doc_id)
select doc.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
  sha256(coalesce(l, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from doc left join hits on hits.doc_id = doc.doc_id left join items on items.doc_id = doc.doc_id
"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _op1_sql() -> str:
    quoted = lambda x: x.replace("'", "''")
    lines = ", ".join(f"({i}, '{name}', '{quoted(text.lower())}')" for i, (name, text) in enumerate(license_scan.TEMPLATES))
    return rf"""
with template(tid, name, text) as (values {lines}),
tt as (select tid, term, count(*) n from (select tid, unnest(regexp_extract_all(text, '[a-z0-9]+')) term from template) group by tid, term),
line as (select doc_id, i, line, regexp_extract_all(translate(line, '{_UPPER}', '{_LOWER}'), '[a-z0-9]+') w
  from (select doc_id, unnest(l) line, unnest(range(len(l))) i from (select doc_id, string_split(coalesce(text, ''), chr(10)) l from documents))),
numbered as (select *, sum(case when len(w) = 0 then 1 else 0 end) over (partition by doc_id order by i) block from line),
top as (select doc_id, min(case when len(w) > 0 and not regexp_matches(line, '{license_scan.COMMENT}') then i end) i from line group by doc_id),
unit as (select doc_id, 0 kind, i place, w from numbered where len(w) > 0 union all select doc_id, 1, block, flatten(list(w order by i)) from numbered where len(w) > 0 group by doc_id, block
  union all select n.doc_id, 2, 0, flatten(list(w order by n.i)) from numbered n join top on top.doc_id = n.doc_id where len(w) > 0 and (top.i is null or n.i < top.i) group by n.doc_id),
named as (select row_number() over () uid, * from unit),
ut as (select uid, term, count(*) n from (select uid, unnest(w) term from named) group by uid, term),
total as (select count(*) n from named where kind = 0),
seen as (select term, count(*) n from ut join named using (uid) where kind = 0 group by term),
idf as (select term, ln((1 + (select n from total)) / (1 + coalesce(seen.n, 0))) + 1 w from (select term from seen union select term from tt) x left join seen using (term)),
tlen as (select tid, sqrt(sum(power(n * w, 2))) l from tt join idf using (term) group by tid),
dot as (select ut.uid, tt.tid, sum(ut.n * idf.w * tt.n * idf.w) d from ut join tt using (term) join idf using (term) group by ut.uid, tt.tid),
ulen as (select uid, sqrt(sum(power(n * w, 2))) l from ut join idf using (term) where uid in (select uid from dot) group by uid),
near as (select uid, name, round(d / (ulen.l * tlen.l), 6) c from dot join ulen using (uid) join tlen using (tid) join template using (tid)),
best as (select doc_id, kind, name, c, len(w) n from (select * from near where c >= {license_scan.LEAST_COSINE} qualify row_number() over (partition by uid order by c desc, name) = 1) join named using (uid)
  union all select doc_id, 0, tag, 1.0, len(w) from (select doc_id, w, unnest(regexp_extract_all(line, '{license_scan.SPDX}', 1)) tag from line)),
own as (select doc_id, arg_min(name, {{'c': -c, 'n': name}}) name, max(c) c from best group by doc_id),
inside as (select doc_id, max(n) n from (select doc_id, kind, sum(n) n from best group by doc_id, kind) group by doc_id),
words as (select doc_id, sum(len(w)) n from line group by doc_id),
file as (select d.doc_id, concat_ws('/', source, cast(d.doc_id // 1000 as varchar), cast(d.doc_id // 100 % 10 as varchar), d.doc_id || '.txt') path, own.name own_license, own.c cosine, inside.n >= words.n / 3.0 mostly
  from documents d left join own on own.doc_id = d.doc_id left join inside on inside.doc_id = d.doc_id left join words on words.doc_id = d.doc_id),
placed as (select *, regexp_extract(path, '^(.*/)?') directory from file),
source as (select directory source, arg_min(own_license, path) license from placed where own_license is not null and mostly group by directory),
above as (select p.doc_id, arg_max(s.source, length(s.source)) up, arg_max(s.license, length(s.source)) license from placed p join source s on starts_with(p.directory, s.source) where p.own_license is null group by p.doc_id)
select p.doc_id, p.path, p.directory, p.own_license, p.cosine, coalesce(p.own_license, above.license) license, above.up inherited_from,
  case when p.own_license is not null then 'own' when above.license is not null then 'inherited' else 'none' end origin
from placed p left join above on above.doc_id = p.doc_id
"""


def _op2_sql() -> str:
    rules = ", ".join(f"('{action}', '{text}', '{text.split('/')[0]}', '{text[text.index('/'):]}')" for action, text in url_filter.RULES)

    def rest(url: str) -> str:
        return f"case when instr({url}, '://') > 0 then substr({url}, instr({url}, '://') + 3) else '' end"

    def place(url: str) -> str:
        return f"translate(regexp_extract({rest(url)}, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') host, regexp_extract({rest(url)}, '^[^/?#]*([^?#]*)', 1) path"

    def node(url: str) -> str:
        return f"translate(regexp_extract({rest(url)}, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') || regexp_extract({rest(url)}, '^[^/?#]*([^#]*)', 1)"

    plain = """list_reduce(list_concat([['']], list_transform(string_split(path, '/')[2:], lambda s: [s])),
    lambda a, s: case when s[1] = '..' then a[1:greatest(len(a) - 1, 1)] when s[1] = '.' then a else list_concat(a, s) end)"""

    def judged(table: str) -> str:
        return f"""select t.*, r.rule, r.action from {table} t left join lateral (select rule, action from rules
  where (t.host = domain or ends_with(t.host, '.' || domain)) and starts_with(t.path, prefix) order by length(rule) desc, action, rule limit 1) r on true"""

    return rf"""
with recursive rules(action, rule, domain, prefix) as (values {rules}),
tag as (select url, unnest(list_concat(
    list_transform(regexp_extract_all(html, '({url_filter.CANONICAL_TAG})', 1), lambda t: regexp_extract(t, '{url_filter.CANONICAL_HREF}', 1)),
    list_transform(regexp_extract_all(html, '({url_filter.REFRESH_TAG})', 1), lambda t: regexp_extract(t, '{url_filter.REFRESH_URL}', 1)))) link
  from pages where instr(url, '://') > 0),
target as (select url, replace(link, '&amp;', '&') link, {place('url')} from tag),
pair as (select url, case when regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') then substr(link, instr(link, '://') + 3)
  when regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') or link = '' or starts_with(link, '#') then null
  when starts_with(link, '//') then substr(link, 3) when starts_with(link, '/') then host || link when starts_with(link, '?') then host || path || link
  else host || case when path = '' then '/' else regexp_extract(path, '^(.*/)?') end || link end target, starts_with(link, '?') asis from target),
cut as (select url, regexp_extract(target, '^([^/?#]*)', 1) host, regexp_extract(target, '^[^/?#]*([^?#]*)', 1) path, regexp_extract(target, '^[^?#]*([^#]*)', 1) query, asis from pair where target is not null),
edge0 as (select {node('url')} x, translate(host, '{_UPPER}', '{_LOWER}') || case when contains(path, '/.') and not asis then array_to_string({plain}, '/')
  || case when regexp_matches(path, '/[.][.]?$') then '/' else '' end else path end || query y from cut),
edge as (select x, y from edge0 union select y, x from edge0),
reach as (select x root, x node from edge union select r.root, e.y from reach r join edge e on e.x = r.node),
member as (select distinct root, node, regexp_extract(node, '^[^/?]*') host, regexp_extract(node, '^[^/?]*([^?]*)', 1) path from reach),
ruled as ({judged('member')}),
blocked as (select root from ruled group by root having bool_or(coalesce(action, '') = 'block') and not bool_or(coalesce(action, '') = 'allow')),
page as (select page_id, {place("coalesce(url, '')")}, {node("coalesce(url, '')")} node from pages),
judged as ({judged('page')})
select page_id, host, path, rule, coalesce(action, case when node in (select root from blocked) then 'block' else 'allow' end) verdict from judged
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_license_scan, op2_url_filter, op3_simhash, op4_decontamination, op5_token_files,
        op6_sentencepiece, op7_toxicity, op8_permutation_index, op9_language_id, op10_token_counts,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": _op1_sql(), "op2_url_filter": _op2_sql(), "op4_decontamination": OP4_SQL}
