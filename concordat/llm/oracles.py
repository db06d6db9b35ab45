"""DuckDB statements that give the rows of those queries that SQL can express.

Left without one: edit distances (op1), sampled n-gram models (op3), minimum cuts (op4), links of
near-duplicate sets (op7, too slow in SQL on whole tables), and token ids (op8, op10). Tests hold those
against brute force.
"""

from __future__ import annotations

from concordat.llm.fixity import FixityConfig
from concordat.llm.license_scan import LicenseConfig, plain_words
from concordat.llm.quality_rules import STOP_WORDS, QualityConfig
from concordat.llm.url_filter import LOWER, UPPER, UrlConfig


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(map(_q, values)) + "]"


def _quality(config: QualityConfig) -> str:
    ratios = {
        "mean_word_chars": "word_chars / greatest(n_words, 1)",
        "symbol_ratio": "n_symbols / greatest(word_chars, 1)",
        "stop_ratio": "n_stop / greatest(n_words, 1)",
        "capital_ratio": "n_capitals / greatest(word_chars, 1)",
        "stutter_ratio": "n_stutter / greatest(n_words, 1)",
        "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
    }
    broken = ", ".join(f"case when {r.metric} {'<' if r.relation == 'min' else '>'} {r.bound} then {_q(r.name)} end" for r in config.rules)
    return rf"""
with d as (select row_number() over () as row, doc_id, coalesce(text, '') as text from documents),
w as (select *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
windows as (select row, i, array_to_string(ws[i + 1 : i + 8], ' ') as g from (select row, ws, unnest(range(0, len(ws) - 7)) as i from w where len(ws) >= 8)),
starts as (select row, i from (select row, i, count(*) over (partition by row, g) as n from windows) where n > 1),
covered as (select row, sum(least(8, coalesce(next - i, 8))) as n from (select row, i, lead(i) over (partition by row order by i) as next from starts) group by row),
m as (select doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as bigint) as word_chars,
        cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols, cast(len(lines) as bigint) as n_lines,
        cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, cast(coalesce(c.n, 0) as bigint) as n_repeat_words,
        len(list_filter(ws, lambda x: list_contains({_list(STOP_WORDS)}, lower(x)))) as n_stop, len(regexp_extract_all(text, '\p{{Lu}}')) as n_capitals,
        len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) as n_stutter
      from w left join covered c on c.row = w.row),
r as (select *, {", ".join(f"{v} as {k}" for k, v in ratios.items())}, n_words < {config.min_words} or 100 * n_repeat_words > {config.max_repeat_percent} * n_words as base_failed from m),
b as (select *, array_to_string(list_filter([{broken}], lambda x: x is not null), ',') as broken_rules from r)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and broken_rules = '' as kept,
       {", ".join(ratios)}, broken_rules from b"""


def _fixity(config: FixityConfig) -> str:
    crlf = "chr(13) || chr(10)"
    raw = f"'WARC/1.1' || {crlf} || 'WARC-Type: response' || {crlf} || 'WARC-Target-URI: ' || url || {crlf} || 'Content-Type: text/html' || {crlf} || 'Content-Length: ' || octet_length(encode(html)) || {crlf} || {crlf} || html || {crlf} || {crlf}"
    records = f"""select *, row_number() over (partition by id, url order by digest) as version from (
        select id, url, sha256(raw) as digest, octet_length(encode(raw)) as length, count(*) as copies from (select id, url, {raw} as raw from {{0}}) group by all)"""
    return f"""
with first as (select page_id as id, coalesce(url, '') as url, coalesce(html, '') as html from pages),
held as (select page_id as id, coalesce(url, '') as url, case when ends_with(html, '</html>') then html else html || '</html>' end as html from pages where not coalesce(contains(url, 'spam-farm'), false)),
second as (select * from held union all select id, split_part(url, '#', 1), html from held where contains(url, '#')),
a as ({records.format("first")}), b as ({records.format("second")}),
placed as (select *, cast('0x' || substr(digest, 1, 8) as bigint) % greatest(1, cast(ceil((select count(*) from a) / {config.records_per_file}) as bigint)) as file from a),
laid as (select *, cast(sum(length) over (partition by file order by id nulls last, encode(url), version) - length as bigint) as "offset" from placed)
select coalesce(l.id, b.id) as page_id, coalesce(l.url, b.url) as url, coalesce(l.version, b.version) as version, l.file, l."offset", l.length,
       case when b.digest is null then 'missing' when l.digest is null then 'extra' else 'changed' end as kind, l.digest as expected, b.digest as found
  from laid l full outer join b on b.id is not distinct from l.id and b.url = l.url and b.version = l.version
 where l.digest is distinct from b.digest or l.copies is distinct from b.copies"""


def _urls(config: UrlConfig) -> str:
    def sql(pattern: str) -> str:
        return _q(pattern.replace(r"\A", "^").replace(r"\z", "$"))

    rules = ", ".join(f"({_q(r.text)}, {_q(r.verdict)}, {sql(r.pattern)}, {r.given})" for r in config.rules)
    return f"""
with u as (select row_number() over () as row, page_id, case when contains(coalesce(url, ''), '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
p as (select row, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
rules(rule, verdict, pattern, given) as (values {rules}),
fits as (select row, rule, verdict, given from p join rules on host || path <> '' and regexp_matches(host || path, pattern)),
best as (select row, arg_max(struct_pack(rule := rule, verdict := verdict), (length(rule), rule)) filter (where given) as site,
                arg_max(struct_pack(rule := rule, verdict := verdict), (length(rule), rule)) filter (where not given) as own from fits group by row)
select page_id, host, path, site.rule as rule, coalesce(site.verdict, own.verdict, 'allow') as verdict, own.rule as pattern_rule from p left join best on best.row = p.row"""


def _licenses(config: LicenseConfig) -> str:
    """All blocks that begin at a place of one of a template's words, counted one by one."""
    rows, names = [], []
    for k, t in enumerate(config.templates):
        rows.append(f"({k}, {_q(t.label)}, {_list(t.words)}, {len(t.words)}, {t.need(config.threshold)}, {t.window(config.stretch)}, {len(t.names)})")
        names += [f"({k}, {_q(n)}, {_list(plain_words(n))})" for n in t.names]
    split = r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    places = []
    for phrase, label in config.phrases:
        parts = phrase.split()
        same = " and ".join(f"ws[i + {k + 1}] = {_q(w)}" for k, w in enumerate(parts))
        places.append(f"list_transform(list_filter(range(0, greatest(len(ws) - {len(parts) - 1}, 0)), lambda i: {same}), lambda i: struct_pack(label := {_q(label)}, start := i))")
    return f"""
with d as (select row_number() over () as row, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as low from documents),
w as (select *, list_filter(regexp_split_to_array(low, {split}), lambda x: x <> '') as ws from d),
t(tid, label, words, size, need, win, n_names) as (values {", ".join(rows)}),
names(tid, name, run) as (values {", ".join(names)}),
tw as (select tid, unnest(words) as word from t),
have as (select row, unnest(list_distinct(ws)) as word from w),
candidates as (select h.row, t.tid, any_value(t.need) as need from have h join tw using (word) join t on t.tid = tw.tid group by h.row, t.tid having count(*) >= any_value(t.need)),
spread as (select row, unnest(ws) as word, generate_subscripts(ws, 1) - 1 as pos from w where row in (select row from candidates)),
places as (
  select c.row, c.tid, s.word as code, s.pos, 1 as long, false as named from candidates c join spread s on s.row = c.row join tw on tw.tid = c.tid and tw.word = s.word
  union all
  select c.row, c.tid, n.name, i, len(n.run), true from candidates c join names n on n.tid = c.tid join w on w.row = c.row, unnest(range(0, len(w.ws) - len(n.run) + 1)) as u(i) where w.ws[i + 1 : i + len(n.run)] = n.run),
counted as (
  select a.row, a.tid, a.pos, count(distinct b.code) filter (where not b.named) as words, count(distinct b.code) filter (where b.named) as found
    from (select distinct row, tid, pos from places) a join t on t.tid = a.tid join places b on b.row = a.row and b.tid = a.tid and b.pos >= a.pos and b.pos + b.long <= a.pos + t.win
   group by a.row, a.tid, a.pos),
hits as (select c.row, list(t.label) as own, max(c.words / t.size) as best from counted c join t on t.tid = c.tid where c.words >= t.need and c.found = t.n_names group by c.row),
b as (select *, list_concat({places[0]}, list_concat({places[1]}, {places[2]})) as places from w),
e as (select b.*, list_sort(list_distinct(list_transform(places, lambda p: p.label))) as base, h.own, h.best from b left join hits h on h.row = b.row)
select doc_id, cast(len(ws) as bigint) as n_words, cast(len(places) as bigint) as n_base, cast(list_min(list_transform(places, lambda p: p.start)) as bigint) as first_word,
       cast(list_max(list_transform(places, lambda p: p.start)) as bigint) as last_word, array_to_string(base, ',') as base_labels,
       array_to_string(list_sort(list_distinct(list_concat(base, coalesce(own, [])))), ',') as labels,
       case when len(places) > 0 then 1.0 else coalesce(best, 0.0) end::double as score from e"""


ORACLES: dict[str, str] = {
    "op2_quality_rules": _quality(QualityConfig()),
    "op5_merkle_fixity": _fixity(FixityConfig()),
    "op6_url_filters": _urls(UrlConfig()),
    "op9_license_scan": _licenses(LicenseConfig()),
}
