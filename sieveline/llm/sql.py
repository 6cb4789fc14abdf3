"""DuckDB SQL for those corpus queries that SQL can express."""

from __future__ import annotations

from .common import LOWER, UPPER
from .rules import SHARES, SYMBOLS, TWO_SIDED
from .urls import LINK, RULES, URL


def _ranks(name: str, source: str, target: str, seed: str, rounds: int, damping: float) -> str:
    """CTEs of a personalised PageRank, a round each."""
    out = [f"{name}_out as materialized (select {source} a, sum(links) n from edges group by 1)", f"{name}_0 as materialized (select host, {seed} rank from hosts)"]
    for i in range(1, rounds + 1):
        flow = f"select e.{target} b, sum(e.links / o.n * r.rank) f from edges e join {name}_out o on e.{source} = o.a join {name}_{i - 1} r on r.host = e.{source} group by 1"
        out.append(f"{name}_{i} as materialized (select s.host, {1 - damping} * s.rank + {damping} * coalesce(f.f, 0.0) rank from {name}_0 s left join ({flow}) f on f.b = s.host)")
    return ", ".join(out)


def url_filter(rounds: int = 40, damping: float = 0.85, threshold: float = 0.01) -> str:
    """From the definition: the longest rule, else the ranks of the host; ``rounds`` rounds settle them."""
    low = lambda c: f"translate({c}, '{UPPER}', '{LOWER}')"
    host = lambda c: low(f"regexp_extract(coalesce({c}, ''), '{URL}', 1)")
    path = lambda c: f"regexp_extract(coalesce({c}, ''), '{URL}', 2)"
    within = lambda d: f"(host = '{d}' or ends_with(host, '.{d}'))"
    named = lambda kind: " or ".join(within(d) for v, d, _ in RULES if v == kind) or "false"
    link = LINK.replace("'", "''")
    longest = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = " ".join(f"when {within(d)} and starts_with(path, '{p}') then '{d}{p}'" for _, d, p in longest)
    says = " ".join(f"when '{d}{p}' then '{v}'" for v, d, p in RULES)
    alone = {"allow": f"(({named('allow')}) and not ({named('block')}))", "block": f"(({named('block')}) and not ({named('allow')}))"}
    seed = {k: f"case when {v} then 1.0::double else {k}ed / urls end" for k, v in alone.items()}
    here = lambda name, kind: f"{name}.rank - case when {alone[kind].replace('host', 'h.host')} then 0.0 else {1 - damping} * {name}_0.rank end"
    return f"""with l as (select {host("url")} src, unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)) "to" from pages),
t as (select src, case when starts_with("to", '//') then 'http:' || "to" else "to" end "to" from l),
targets as (select src, {host('"to"')} host, {path('"to"')} path from t),
edges as materialized (select src, host dst, count(*) links from targets where src != '' and host != '' and src != host group by 1, 2),
own as (select page_id, {host("url")} host, {path("url")} path from pages),
known as (select host, path from own where host != '' union all select host, path from targets where host != ''),
judged_urls as (select host, case (case {fits} end) {says} end verdict from known),
hosts as materialized (select host, count(*) urls, count(*) filter (verdict = 'allow') allowed, count(*) filter (verdict = 'block') blocked from judged_urls group by 1),
{_ranks("trust", "src", "dst", seed["allow"], rounds, damping)}, {_ranks("distrust", "dst", "src", seed["block"], rounds, damping)},
judged as (select h.host, case when ({here("distrust", "block")}) - ({here("trust", "allow")}) > {threshold} then 'block' else 'allow' end verdict from hosts h join trust_{rounds} trust on trust.host = h.host join trust_0 on trust_0.host = h.host join distrust_{rounds} distrust on distrust.host = h.host join distrust_0 on distrust_0.host = h.host),
ruled as (select *, case {fits} end rule from own)
select page_id, r.host, path, rule, coalesce(case rule {says} end, j.verdict, 'allow') verdict from ruled r left join judged j on j.host = r.host"""


def near_duplicates(words: int = 4, num: int = 85, den: int = 100) -> str:
    last = words - 1
    return f"""with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x != '') l from documents),
s as (select distinct doc_id, unnest(case when len(l) = 0 then []::varchar[] when len(l) < {words} then [array_to_string(l, ' ')] else [array_to_string(l[i:i + {last}], ' ') for i in range(1, len(l) - {last - 1})] end) sh from w),
n as (select doc_id, count(*) n from s group by 1),
p as (select a.doc_id x, b.doc_id y, count(*) c from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2),
e as (select x, y from p join n i on i.doc_id = x join n j on j.doc_id = y where {den} * c >= {num} * (i.n + j.n - c)),
u as (select x, y from e union select y, x from e),
r(node, reached) as (select doc_id, doc_id from documents union select r.node, u.y from r join u on u.x = r.reached)
select d.doc_id, coalesce(n.n, 0) n_shingles, m.component_id from documents d left join n on n.doc_id = d.doc_id join (select node, min(reached) component_id from r group by 1) m on m.node = d.doc_id"""


def quality_rules(prior: int = 100, reach: float = 3.0, chance: float = 100.0) -> str:
    """The rules from their definition: counts, base rules, quartiles of bucketed values, thresholds, verdicts."""
    space, word = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
    share = lambda m: f"(1000 * {SHARES[m][0]} // greatest({SHARES[m][1]}, 1))"
    values = " union all ".join(f"select rid, lang, source, '{m}' measure, {share(m)} v from counted where not base_failed" for m in SHARES)
    merged = lambda keys: f"select *, sum(n) over (partition by {keys}, measure order by edge) upto, sum(n) over (partition by {keys}, measure) total from (select {keys}, measure, edge, count(*) n from sketch group by all)"
    quart = lambda keys: f"select {keys}, measure, any_value(total) total, min(edge) filter (4 * upto >= total) low, min(edge) filter (4 * upto >= 3 * total) high from ({merged(keys)}) group by all"
    drawn = lambda c: f"(o.total * o.{c} + {prior} * w.{c})::double / (o.total + {prior})::double"
    least = "case v.measure " + " ".join(f"when '{m}' then {SHARES[m][2]}" for m in SHARES) + " end"
    low = " or ".join(f"v.measure = '{m}'" for m in TWO_SIDED)
    return f"""with d as (select row_number() over () rid, doc_id, coalesce(text, '') t, coalesce(lang, '') lang, coalesce(source, '') source from documents),
w as (select rid, list_filter(string_split_regex(t, '{space}'), lambda x: x != '') l, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) lines from d),
windows as (select rid, unnest(range(1, len(l) - 3)) i, unnest([array_to_string(l[i:i + 4], ' ') for i in range(1, len(l) - 3)]) win from w),
twice as (select rid, i from (select rid, i, count(*) over (partition by rid, win) n from windows) where n > 1),
again as (select rid, count(distinct i + k) n from twice, range(5) r(k) group by 1),
counts as (select d.rid, doc_id, lang, source, len(l)::bigint n_words, length(array_to_string(l, ''))::bigint word_chars, len(regexp_extract_all(t, '{SYMBOLS}'))::bigint n_symbols, len(lines)::bigint n_lines, (len(lines) - len(list_distinct(lines)))::bigint n_dup_lines, coalesce(again.n, 0)::bigint n_repeat_words from d join w on w.rid = d.rid left join again on again.rid = d.rid),
counted as materialized (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed from counts),
measured as materialized ({values}),
sketch as (select lang, source, measure, (v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0) edge from measured),
own as ({quart("lang, source")}), whole as ({quart("lang")}),
limits as (select o.lang, o.source, o.measure, {drawn("low")} low, {drawn("high")} high from own o join whole w on w.lang = o.lang and w.measure = o.measure),
failed as (select distinct v.rid from measured v join counted c on c.rid = v.rid join limits t on t.lang = v.lang and t.source = v.source and t.measure = v.measure
where v.v > t.high + {reach}::double * greatest(t.high - t.low, {least}) * (1 + sqrt({chance}::double / c.n_words)) or ({low}) and v.v < t.low - {reach}::double * greatest(t.high - t.low, {least}) * (1 + sqrt({chance}::double / c.n_words)))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and f.rid is null kept from counted c left join failed f on f.rid = c.rid"""


def importance(percent: int = 10, min_words: int = 20, buckets: int = 10_000, salt: str = "2024") -> str:
    """Single words as features; crc32 is computed from its polynomial, once for each distinct word."""
    low = lambda c: f"translate(coalesce({c}, ''), '{UPPER}', '{LOWER}')"
    words = lambda c: f"regexp_extract_all({low(c)}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    step = "lambda c, b: xor(c >> 8, tab[xor(c, b) % 256 + 1])"
    octets = "list_transform(range(0, octet_length(encode(word))::bigint), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::bigint)"
    return f"""with tab as materialized (select list_transform(range(0, 256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) tab),
d as materialized (select row_number() over () rid, doc_id, {words("text")} w from documents),
dw as materialized (select rid, unnest(w) word from d), bw as materialized (select unnest({words("text")}) word from benchmark),
crcs as materialized (select word, xor(list_reduce(list_prepend(4294967295, {octets}), {step}), 4294967295) % {buckets} bucket from (select word from dw union select word from bw), tab),
s as (select bucket, count(*) n from dw join crcs using (word) group by 1), t as (select bucket, count(*) n from bw join crcs using (word) group by 1),
gains as materialized (select b.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::double * ((select count(*) from dw) + {buckets})::double / ((coalesce(s.n, 0) + 1)::double * ((select count(*) from bw) + {buckets})::double)))::bigint gain from (select unnest(range({buckets})) bucket) b left join s on s.bucket = b.bucket left join t on t.bucket = b.bucket),
weights as (select rid, floor(sum(gain) / count(*))::bigint weight from dw join crcs using (word) join gains using (bucket) group by 1),
scored as materialized (select d.rid, doc_id, len(w)::bigint n_features, coalesce(weight, 0)::bigint weight, (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{salt}:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296::double))))::bigint score from d left join weights on weights.rid = d.rid),
able as (select rid, row_number() over (order by score desc, doc_id nulls last, n_features, weight) rank, count(*) over () n from scored where n_features >= {min_words})
select doc_id, n_features, weight, score, case when rank <= {percent} * n // 100 then rank end rank from scored left join able using (rid)"""


def prefix_trie(heads: int = 6, family: int = 100) -> str:
    """Sequences as lists; each node's ancestors are the prefixes of its smallest conversation. crc32 as in ``importance``."""
    octets = "list_transform(range(0, length(conv_id::varchar)), lambda i: ascii(substr(conv_id::varchar, i::int + 1, 1))::bigint)"
    return f"""with tab as materialized (select list_transform(range(0, 256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) tab),
o as materialized (select conv_id, list({{'role': coalesce(role, ''), 'text': coalesce("text", '')}} order by turn nulls first, role nulls first, "text" nulls first) l from conversations where conv_id is not null group by 1),
h as (select conv_id, l, xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, tab[xor(c, b) % 256 + 1])), 4294967295) % {heads} h from o, tab),
r as materialized (select h.conv_id, list_concat(coalesce(b.l[1:h.h], []), h.l[h.h + 1:]) l from h left join o b on b.conv_id = h.conv_id - h.conv_id % {family}),
m as materialized (select conv_id, len(l) n, d depth, md5(l[1:d]::varchar) || sha256(to_json(l[1:d])::varchar) k, l[d]['text'] "text" from (select *, unnest(range(0, len(l) + 1)) d from r)),
n as materialized (select depth, k, min(conv_id) conv_id, count(*) n_convs, (count(*) - 1) * coalesce(length(any_value("text")), 0) own, coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (n = depth), '') ends from m group by 1, 2),
path as materialized (select n.conv_id, n.depth, n.own, a.depth up_depth, b.conv_id up from n join m a on a.conv_id = n.conv_id and a.depth <= n.depth join n b on b.depth = a.depth and b.k = a.k),
kids as materialized (select up conv_id, up_depth depth, count(*) n_children from path where up_depth = depth - 1 group by 1, 2),
sums as (select p.up conv_id, p.up_depth depth, sum(p.own)::bigint saved_tokens, count(*) filter (k.n_children is null) n_leaves from path p left join kids k on k.conv_id = p.conv_id and k.depth = p.depth group by 1, 2)
select n.conv_id, n.depth, p.up parent_conv_id, n.n_convs, coalesce(k.n_children, 0) n_children, s.n_leaves, s.saved_tokens, sha256(n.ends) ends_sha256 from n left join path p on p.conv_id = n.conv_id and p.depth = n.depth and p.up_depth = n.depth - 1 left join kids k on k.conv_id = n.conv_id and k.depth = n.depth join sums s on s.conv_id = n.conv_id and s.depth = n.depth"""


ORACLES: dict[str, str] = {"op3_url_filter": url_filter(), "op10_jaccard_parity": near_duplicates(), "op11_importance_resampling": importance(), "op12_conversation_trie": prefix_trie(), "op13_quality_rules": quality_rules()}
