"""The registered queries of the operators in this subpackage, on whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.llm import (
    conversations,
    credentials,
    decontam,
    language,
    licenses,
    merkle,
    packing,
    quality,
    rules,
    simhash,
    topk,
    toxicity,
    urlfilter,
)

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_read(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = credentials.scan(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_matches(_read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.array_distinct("matches.license"), ",").alias("licenses"),
    )


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlfilter.filter_urls(_read(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_read(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(_read(spark, sf_dir, "documents")).drop("failed")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_read(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(_read(spark, sf_dir, "conversations"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_simhash_near_duplicates,
        op2_quality_classifier,
        op3_secret_scan,
        op4_exact_top_k,
        op5_harmonic_packing,
        op6_license_scan,
        op7_url_filter,
        op8_language_id,
        op9_benchmark_decontamination,
        op10_toxicity,
        op11_quality_rules,
        op12_merkle_manifest,
        op13_conversation_repair,
    )
}

#: Integer inner products of every query with all other rows.
_OP4_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id,
    list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::bigint as score
  from v q join v c on c.vec_id != q.vec_id where q.vec_id % 50 = 0
), ranked as (
  select *, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""

#: A window of each template's length, with room for one tenth at both ends, at every word of every text.
_OP6_SQL = """
with t as (
  select name, list_filter(regexp_split_to_array(lower(body), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as w
  from (values VALUES) v(name, body)
), s as (
  select name, len(w) - 4 as n, round_even((len(w) - 4) * 0.1, 0)::int as room,
    list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) as own
  from t
), d as (
  select row_number() over () as r, doc_id,
    list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as w
  from documents
), h as (
  select r, list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i + 4], ' ')) as found from d
), p as (
  select r, name, n, room, own, found, unnest(range(0, len(found))) as place from h join s on list_has_any(found, own)
), good as (
  select r, name, n, place from p
  where len(list_distinct(list_intersect(found[greatest(place - room, 0) + 1:place + n + room], own)))
    >= 0.8 * len(list_distinct(own))
), matches as (
  select r, name, sum((gap is null or gap >= n + 4)::int) as times
  from (select *, place - lag(place) over (partition by r, name order by place) as gap from good) group by r, name
)
select d.doc_id, coalesce(sum(times), 0)::bigint as n_matches, coalesce(string_agg(name, ',' order by name), '') as licenses
from d left join matches using (r) group by d.r, d.doc_id
""".replace("VALUES", ", ".join(f"('{k}', '{v}')" for k, v in licenses.TEMPLATES.items()))

_OP7_SQL = """
with u as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end as rest from pages
), p as (
  select page_id,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path
  from u
), j as (
  select *, '.' || host as h,
    case
      when ('.' || host) like '%.www.example.com' and starts_with(path, '/en/') then 'www.example.com/en/'
      when ('.' || host) like '%.example.com' and starts_with(path, '/en/') then 'example.com/en/'
      when ('.' || host) like '%.net' and starts_with(path, '/es/') then 'net/es/'
      when ('.' || host) like '%.net' and starts_with(path, '/fr/') then 'net/fr/'
      when ('.' || host) like '%.com' and starts_with(path, '/') then 'com/'
    end as rule
  from p
)
select page_id, host, path, rule,
  case
    when rule in ('example.com/en/', 'net/es/', 'net/fr/') then 'block'
    when rule is not null then 'allow'
    when regexp_matches(h, '[.](spam|casino|cheap|free)-') then 'block'
    when contains(path, '/wp-login.php') or contains(path, '/cgi-bin/') then 'block'
    else 'allow'
  end as verdict
from j
"""

def _blanks(text: str) -> str:
    """The text with all white space as spaces."""
    marks = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"translate({text}, {marks}, '     ')"


def _rule_sql(rule: rules.Rule) -> str:
    per = rule.per or "1"
    low = f"100 * {rule.measure} < {round(100 * rule.least)} * {per}" if rule.least is not None else "false"
    high = f"100 * {rule.measure} > {round(100 * rule.most)} * {per}" if rule.most is not None else "false"
    return f"(n_words >= {rule.words} and ({low} or {high}))"


def _count_sql(text: str, letters: str) -> str:
    return f"length({text}) - length(translate({text}, '{letters}', ''))"


_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_OP11_SQL = f"""
with d as (
  select row_number() over () as r, doc_id, coalesce(text, '') as t from documents
), w as (
  select *, list_filter(string_split({_blanks('t')}, ' '), lambda x: x <> '') as w,
    list_filter(string_split(t, chr(10)), lambda x: trim({_blanks('x')}) <> '') as l
  from d
), places as (
  select r, unnest(range(1, len(w) + 1)) as i, unnest(w) as x from w
), windows as (
  select r, i, count(*) over (partition by r, x) as n from (
    select r, i, concat_ws(' ', x, lead(x, 1) over p, lead(x, 2) over p, lead(x, 3) over p, lead(x, 4) over p) as x,
      lead(i, 4) over p is not null as whole
    from places window p as (partition by r order by i)
  ) where whole
), repeats as (
  select r, sum(least(5, coalesce(i - before, 5))) as n
  from (select r, i, lag(i) over (partition by r order by i) as before from windows where n > 1) group by r
), m as (
  select doc_id, len(w) as n_words, coalesce(len(array_to_string(w, '')), 0) as word_chars,
    {_count_sql('t', rules.SYMBOLS)} as n_symbols,
    len(l) - len(list_distinct(l)) as n_dup_lines,
    coalesce(n, 0) as n_repeat_words,
    {_count_sql('t', rules.MARKS)} as n_marks,
    {_count_sql('t', _AZ)} as n_capitals,
    len(list_filter(w, lambda x: translate(x, '{_AZ}.,;:!?', '{_AZ.lower()}') in ({', '.join(f"'{x}'" for x in rules.STOP_WORDS)}))) as n_stops,
    len(l) as n_lines,
    len(list_filter(l, lambda x: x like '%...' or x like '%…')) as n_dotted
  from w left join repeats using (r)
)
select doc_id, {', '.join(f'{m}::bigint as {m}' for m in rules.MEASURES)},
  {' or '.join(_rule_sql(r) for r in rules.RULES if r.base)} as base_failed,
  not ({' or '.join(_rule_sql(r) for r in rules.RULES)}) as kept
from m
"""


#: The checksum of a short text: `crc` is the table of a byte's steps, `crc_of(x)` is written out by `_crc_sql`.
_CRC_TABLE_SQL = """crc as (
  select list(v order by i) as steps from (
    select i, list_reduce(range(8), lambda c, k: xor(c >> 1, (c & 1) * 3988292384), i) as v from range(256) t(i)
  )
)"""


def _crc_sql(text: str) -> str:
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ord(substr({text}, i, 1))::bigint)"
    folded = f"list_reduce({codes}, lambda c, b: xor(c >> 8, steps[xor(c & 255, b) + 1]), 4294967295)"
    return f"xor({folded}, 4294967295)"


def _tree_sql(nodes: str, levels: int) -> str:
    """For each level of the tree over `nodes` (k, number, hash) the runs of eight and the digest of each."""
    ctes, last = [], nodes
    for i in range(levels):
        ctes.append(f"""{nodes}{i} as (
  select k, number // 8 as number, max(total) as total, list(hash order by number) as run,
    case when max(total) > 1 then sha256(string_agg(hash, '' order by number)) else max(hash) end as hash
  from (select k, number, hash, count(*) over (partition by k) as total from {last}) group by k, number // 8
)""")
        last = f"{nodes}{i}"
    return ",\n".join(ctes)


def _climb_sql(rows: str, nodes: str, levels: int) -> str:
    """Folds `f` and gathers the siblings `sib` of `rows` (k, number, f, sib, ..) up the tree over `nodes`."""
    ctes, last = [], rows
    for i in range(levels):
        before = "coalesce(array_to_string(g.run[1:p.number % 8], ''), '')"
        after = "coalesce(array_to_string(g.run[p.number % 8 + 2:], ''), '')"
        ctes.append(f"""{rows}{i} as (
  select p.* replace (
    p.number // 8 as number,
    case when g.total > 1 then sha256({before} || f || {after}) else f end as f,
    case when g.total > 1 then sib || {before} || {after} else sib end as sib)
  from {last} p join {nodes}{i} g on g.k = p.k and g.number = p.number // 8
)""")
        last = f"{rows}{i}"
    return ",\n".join(ctes)


def _leaf_sql(text: str) -> str:
    fields = [f"coalesce(strlen({x}::varchar) || ':' || {x}::varchar, '-')" for x in ("doc_id", "source", "lang", "n_chars", text)]
    return "sha256(" + " || ".join(fields) + ")"


#: Trees of up to 8**8 rows a language and 8**4 languages.
_OP12_SQL = f"""
with {_CRC_TABLE_SQL}, leaves as (
  select row_number() over () as r, doc_id, coalesce('=' || lang, '') as k, {_leaf_sql('text')} as leaf,
    case when {_crc_sql('doc_id::varchar')} % 3 = 0 then {_leaf_sql(f"translate(text, '{_AZ}', '{_AZ.lower()}')")} end as changed
  from documents, crc
), docs as (
  select *, row_number() over (partition by k order by doc_id nulls first, leaf) - 1 as number, leaf as hash from leaves
), {_tree_sql('docs', 8)},
langs as (
  select 0 as k, row_number() over (order by k) - 1 as number, hash, k as lang from docs7
), {_tree_sql('langs', 4)},
proof as (
  select doc_id, leaf, k, number, coalesce(changed, leaf) as f, '' as sib from docs
), {_climb_sql('proof', 'docs', 8)},
upper as (
  select p.doc_id, p.leaf, l.k, l.number, p.f, p.sib, l.hash as subroot from proof7 p join langs l on l.lang = p.k
), {_climb_sql('upper', 'langs', 4)}
select doc_id, leaf, subroot, (select hash from langs3) as root, sha256(sib) as proof_sha256, f as folded_root,
  f = (select hash from langs3) as verified
from upper3
"""

_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

#: Costs to the end from each grammar state (nothing yet, after s, u, a), then the edits from the start.
_OP13_SQL = f"""
with recursive {_CRC_TABLE_SQL}, given as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    {_crc_sql("(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))")} % 20 as code
  from conversations, crc
), damaged as (
  select conv_id, turn, case when code = 4 then 'user' else role end as role,
    case code when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
    unnest(range(case when code = 3 then 2 else 1 end)) as copy
  from given where code <> 0
), placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i,
    row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as again,
    lag(role) over (partition by conv_id order by turn nulls first, role, text, copy) as before,
    rtrim(text, {_WHITE}) as shown
  from damaged
), faults as (
  select *, role[1] as r, case when shown = '' then 'blank' when again > 1 then 'duplicate'
    when shown[-1] not in ('.', '!', '?') then 'truncated' end as fault
  from placed
), rows as (
  select conv_id, i, r, role, text, fault in ('blank', 'duplicate') and fault is not null as gone,
    case when fault = 'truncated' then 5 else 0 end as late
  from faults
), counts as (
  select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
    count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
    count(*) filter (fault = 'truncated') as truncated,
    count(*) filter (before is not null and before[1] || r not in ('su', 'ua', 'au')) as illegal
  from faults group by conv_id
), back as (
  select conv_id, n as i, 0::bigint as c0, 10::bigint as cs, 5::bigint as cu, 0::bigint as ca from counts
  union all
  select conv_id, i, least(b0, 5 + nu) as c0, least(bs, 5 + nu) as cs, nu as cu, least(ba, 5 + bu) as ca
  from (
    select *, least(bu, 5 + ba) as nu from (
      select b.conv_id, b.i - 1 as i,
        least(2 + c0, case when not gone then least(1 + late + cu, case r when 's' then late + cs when 'u' then late + cu end) end) as b0,
        least(2 + cs, case when not gone then least(1 + late + cu, case r when 'u' then late + cu end) end) as bs,
        least(2 + cu, case when not gone then least(1 + late + ca, case r when 'a' then late + ca end) end) as bu,
        least(2 + ca, case when not gone then least(1 + late + cu, case r when 'u' then late + cu end) end) as ba
      from back b join rows w on w.conv_id is not distinct from b.conv_id and w.i = b.i
    )
  )
), costs as (
  select conv_id, i, [c0, cs, cu, ca] as c from back
), walk as (
  select conv_id, 0::bigint as i, 1 as s, '' as audit, []::varchar[] as kept, false as ended from counts
  union all
  select conv_id, case when e = 'I' then i else i + 1 end as i, case e when 'D' then s when 'K' then ks else ns end as s,
    audit || e as audit,
    case e when 'D' then kept when 'K' then list_append(kept, role || ':' || text)
      else list_append(kept, case ns when 3 then 'user' else 'assistant' end || ':' || case e when 'I' then '' else text end) end as kept,
    e = '' as ended
  from (
    select *, case
      when done and c[s] = 0 then ''
      when not done and c[s] = 2 + d[s] then 'D'
      when c[s] = 5 + c[ns] then 'I'
      when ks is not null and c[s] = late + d[ks] then 'K'
      else 'R' end as e
    from (
      select w.*, x.role, x.text, x.late, a.c, b.c as d, b.c is null as done, case s when 3 then 4 else 3 end as ns,
        case when x.gone then null when s = 1 and r = 's' then 2 when s <> 3 and r = 'u' then 3 when s = 3 and r = 'a' then 4 end as ks
      from walk w
      join costs a on a.conv_id is not distinct from w.conv_id and a.i = w.i
      left join costs b on b.conv_id is not distinct from w.conv_id and b.i = w.i + 1
      left join rows x on x.conv_id is not distinct from w.conv_id and x.i = w.i + 1
      where not w.ended
    )
  )
), ended as (
  select conv_id, audit, sha256(array_to_string(kept, chr(10))) as sha from walk where ended
), total as (
  select conv_id, c[1] as cost from costs where i = 0
)
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
  coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(cost, 0)::bigint as cost,
  coalesce(audit, '') as audit, coalesce(sha, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) o
left join counts c on c.conv_id is not distinct from o.conv_id
left join total t on t.conv_id is not distinct from o.conv_id
left join ended e on e.conv_id is not distinct from o.conv_id
"""

#: DuckDB SQL for the queries that SQL can express. The others train models, hash with a seed, or need places
#: of pattern matches and token ids; tests compare them with brute force.
ORACLES: dict[str, str] = {
    "op4_exact_top_k": _OP4_SQL,
    "op6_license_scan": _OP6_SQL,
    "op7_url_filter": _OP7_SQL,
    "op11_quality_rules": _OP11_SQL,
    "op12_merkle_manifest": _OP12_SQL,
    "op13_conversation_repair": _OP13_SQL,
}
