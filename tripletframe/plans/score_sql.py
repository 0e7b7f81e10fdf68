"""DuckDB text of the lexical and vector pair metrics (E7-E14, E17): the second formulas that the queries are held against.

Everything starts from ``lng(pair_id, row_id, label, reference, candidate)``.
Side 0 is the candidate, side 1 the reference.
"""

from __future__ import annotations

from tripletframe.functions.keys import hkey_sql
from tripletframe.functions.porter import _STEP2, _STEP3, _STEP4
from tripletframe.operators.scoring import PAD_TOKEN
from tripletframe.sources.fixtures import TOKEN_DIM, hashed_vectors_sql

# A stem as [consonants](vowels consonants)^m[vowels]; an initial y is written Y, being a consonant.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"


def _more_than(stem: str, m: int) -> str:
    return f"regexp_matches({stem}, '^({_C})?{(_V + _C) * (m + 1)}')"


def _just_one(stem: str) -> str:
    return f"regexp_matches({stem}, '^({_C})?{_V}{_C}({_V})?$')"


def _vowel(stem: str) -> str:
    return f"regexp_matches({stem}, '^({_C})?[aeiouy]')"


def _short(stem: str) -> str:
    return f"regexp_matches({stem}, '^{_C}[aeiouy][^aeiouwxy]$')"


def _double(w: str) -> str:
    return f"(length({w}) > 1 and right({w}, 1) = left(right({w}, 2), 1) and regexp_matches({w}, '([^aeiouy]|[^aeiouy]yy)$'))"


def _suffixes(rules, cond) -> str:
    return "case " + " ".join(f"when w like '%{s}' then case when {cond(f'left(w, -{len(s)})', s)} then left(w, -{len(s)}) || '{r}' else w end" for s, r in rules) + " else w end"


def stem_ctes(words: str) -> str:
    """CTEs from ``words(word)`` to ``stems(word, stem, root)``: root is the Porter stem, stem the same for words longer than three letters."""
    last = sorted(((s, "") for s in _STEP4), key=lambda x: -len(x[0]))
    at4 = lambda s, suffix: _more_than(s, 1) + (f" and right({s}, 1) in ('s', 't')" if suffix == "ion" else "")
    return f"""st0 as (select distinct word, regexp_replace(word, '^y', 'Y') as w from {words}),
st1 as (select word, case when w like '%sses' or w like '%ies' then left(w, -2) when w like '%ss' then w when w like '%s' then left(w, -1) else w end as w from st0),
st2 as (select word, case when w like '%eed' then case when {_more_than('left(w, -3)', 0)} then left(w, -1) else w end
    when w like '%ed' and {_vowel('left(w, -2)')} then left(w, -2) when w like '%ing' and {_vowel('left(w, -3)')} then left(w, -3) else w end as w,
  w not like '%eed' and (w like '%ed' and {_vowel('left(w, -2)')} or w like '%ing' and {_vowel('left(w, -3)')}) as cut from st1),
st3 as (select word, case when not cut then w when w like '%at' or w like '%bl' or w like '%iz' then w || 'e'
    when {_double('w')} and right(w, 1) not in ('l', 's', 'z') then left(w, -1) when {_short('w')} then w || 'e' else w end as w from st2),
st4 as (select word, case when w like '%y' and {_vowel('left(w, -1)')} then left(w, -1) || 'i' else w end as w from st3),
st5 as (select word, {_suffixes(_STEP2, lambda s, _: _more_than(s, 0))} as w from st4),
st6 as (select word, {_suffixes(_STEP3, lambda s, _: _more_than(s, 0))} as w from st5),
st7 as (select word, {_suffixes(last, at4)} as w from st6),
st8 as (select word, case when w like '%e' and ({_more_than('left(w, -1)', 1)} or {_just_one('left(w, -1)')} and not {_short('left(w, -1)')}) then left(w, -1) else w end as w from st7),
st9 as (select word, lower(case when {_more_than('w', 1)} and {_double('w')} and w like '%l' then left(w, -1) else w end) as w from st8),
stems as (select word, case when length(word) > 3 then w else word end as stem, case when length(word) > 2 then w else word end as root from st9)"""


_WORDS = "list_filter(string_split(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')"


def token_ctes() -> str:
    """``lng`` -> tok(pair_id, side, pos, word), stems, ts (tokens with stems), arr(pair_id, g, r): stems in order."""
    return f"""sides as (select pair_id, 0 as side, {_WORDS.format(c='candidate')} as t from lng union all select pair_id, 1, {_WORDS.format(c='reference')} from lng),
tok as (select pair_id, side, unnest(range(len(t))) as pos, unnest(t) as word from sides),
{stem_ctes('tok')},
ts as (select tok.*, stem, root from tok join stems using (word)),
arr as (select lng.pair_id, coalesce(list(stem order by pos) filter (where side = 0), []) as g, coalesce(list(stem order by pos) filter (where side = 1), []) as r
  from lng left join ts using (pair_id) group by lng.pair_id)"""


def _f1(ov: str, ng: str, nr: str) -> str:
    return f"case when {ov} > 0 then 2.0 * {ov} / ({ng} + {nr}) else 0.0 end"


def rouge_ctes() -> str:
    """r1f1, r2f1 (clipped n-gram overlap) and rLf1 (longest common subsequence, a running maximum a row)."""
    grams = lambda a: f"case when len({a}) > 1 then list_transform(range(1, len({a})), lambda i: {a}[i] || ' ' || {a}[i + 1]) else [] end"
    n_gram = lambda k, g, r: f"""gr{k} as (select pair_id, unnest({g}) as gram, 0 as side from arr union all select pair_id, unnest({r}), 1 from arr),
ov{k} as (select pair_id, sum(least(kg, kr)) as ov, sum(kg) as ng, sum(kr) as nr from (
  select pair_id, gram, sum(1 - side) as kg, sum(side) as kr from gr{k} group by all) group by pair_id),
r{k}f1 as (select arr.pair_id, {_f1('ov', 'ng', 'nr')} as score from arr left join ov{k} using (pair_id))"""  # noqa: E731
    return f"""{n_gram(1, 'g', 'r')},
{n_gram(2, grams('g'), grams('r'))},
lcs as (select pair_id, len(g) as ng, len(r) as nr, case when len(g) * len(r) = 0 then 0 else list_max(list_reduce(
    list_prepend(list_transform(g, lambda x: 0), list_transform(r, lambda y: list_transform(g, lambda x: case when x = y then 1 else 0 end))),
    lambda row, hit: list_transform([list_transform(hit, lambda h, j: case when h = 1 then (case when j > 1 then row[j - 1] else 0 end) + 1 else row[j] end)],
      lambda c: list_transform(c, lambda x, j: list_max(c[1:j])))[1])) end as ov from arr),
rLf1 as (select pair_id, {_f1('ov', 'ng', 'nr')} as score from lcs)"""


def meteor_ctes(synonyms: str | None = None) -> str:
    """Words matched exactly, then by stem, then by synset (``synonyms(word, synset)``); each stage pairs the k-th last free occurrences."""
    terms = ["ts.word", "ts.root", *(["coalesce(synset, ts.word)"] if synonyms else [])]
    ctes = [f"free0 as (select ts.*, {', '.join(f'{t} as t{i}' for i, t in enumerate(terms))} from ts" + (f" left join {synonyms} sy on sy.word = ts.word" if synonyms else "") + ")"]
    for i in range(len(terms)):
        ctes.append(f"""rank{i} as (select pair_id, side, pos, t{i} as t, row_number() over (partition by pair_id, side, t{i} order by pos desc) as k from free{i}),
hit{i} as (select h.pair_id, h.pos as i, r.pos as j from rank{i} h join rank{i} r on h.side = 0 and r.side = 1 and h.pair_id = r.pair_id and h.t = r.t and h.k = r.k),
free{i + 1} as (select * from free{i} f where not exists (select 1 from hit{i} x where x.pair_id = f.pair_id and f.pos = case when f.side = 0 then x.i else x.j end))""")
    hits = " union all ".join(f"select * from hit{i}" for i in range(len(terms)))
    return ",\n".join(ctes) + f""",
steps as (select *, i - lag(i) over w = 1 and j - lag(j) over w = 1 as joined from ({hits}) window w as (partition by pair_id order by i)),
found as (select pair_id, count(*) as m, count(*) filter (where joined is null or not joined) as chunks from steps group by pair_id),
sizes as (select pair_id, count(*) filter (where side = 0) as nh, count(*) filter (where side = 1) as nr from tok group by pair_id),
meteor as (select lng.pair_id, coalesce((1 - 0.5 * power(chunks / m, 3)) * ((m / nh) * (m / nr) / (0.9 * m / nh + 0.1 * m / nr)), 0.0) as score
  from lng left join found using (pair_id) left join sizes using (pair_id))"""


def _vector_sum(name: str, length: int, pad: str) -> str:
    """``name(pair_id, score)``: cosine of the padded means of both sides' word vectors."""
    return f"""{name}_e as (select pair_id, side, j, (s + greatest({length} - n, 0) * pv) / greatest(n, {length}) as e from vsum join vpad using (j)),
{name} as (select a.pair_id, sum(a.e * b.e) / (sqrt(sum(a.e * a.e)) * sqrt(sum(b.e * b.e)){pad}) as score
  from {name}_e a join {name}_e b on a.pair_id = b.pair_id and a.side = 0 and b.side = 1 and a.j = b.j group by a.pair_id)"""


def vector_ctes() -> str:
    """embsim (plain means), simcse (means padded to 512 positions), bert (greedy word matching)."""
    return f"""vtok as (select word as token from tok),
vec as ({hashed_vectors_sql('vtok')}),
vpad as (select cast(range as integer) as j, cast({hkey_sql(f"'{PAD_TOKEN}'", 'range')} % 2001 - 1000 as double) / 1000 as pv from range({TOKEN_DIM})),
vbag as (select pair_id, side, word as token, count(*) as k from tok group by all),
vn as (select pair_id, side, sum(k) as n from vbag group by all),
vsum as (select vbag.pair_id, vbag.side, j, any_value(n) as n, sum(k * v) as s from vbag join vec using (token) join vn on vn.pair_id = vbag.pair_id and vn.side = vbag.side group by all),
{_vector_sum('embsim', 1, ' + 1e-8')},
{_vector_sum('simcse', 512, '')},
va as (select token, list(v order by j) as a from vec group by token),
vu as (select token, list_transform(a, lambda x: x / sqrt(list_dot_product(a, a))) as u from va),
vb as (select vbag.*, u from vbag join vu using (token)),
vs as (select c.pair_id, c.token as ct, c.k as ck, r.token as rt, r.k as rk, list_dot_product(c.u, r.u) as sim from vb c join vb r on c.pair_id = r.pair_id and c.side = 0 and r.side = 1),
vp as (select pair_id, sum(ck * m) / sum(ck) as p from (select pair_id, ct, ck, max(sim) as m from vs group by all) group by pair_id),
vr as (select pair_id, sum(rk * m) / sum(rk) as r from (select pair_id, rt, rk, max(sim) as m from vs group by all) group by pair_id),
bert as (select pair_id, case when p + r <> 0 then 2 * p * r / (p + r) else 0 end as score from vp join vr using (pair_id))"""


FEATURES = ("r1f1", "r2f1", "rLf1", "meteor", "embsim", "bert", "simcse")


def learned_ctes() -> str:
    """Least squares of the label on an intercept and FEATURES: normal equations, eliminated column by column."""
    n = len(FEATURES) + 1
    return f"""wide as (select lng.pair_id, [1.0::double, {', '.join(f'{f}.score' for f in FEATURES)}, lng.label::double] as x
  from lng {' '.join(f'join {f} on {f}.pair_id = lng.pair_id' for f in FEATURES)}),
cells as (select i, j, sum(x[i] * x[j]) as s from wide, (select unnest(range(1, {n + 1})) as i), (select unnest(range(1, {n + 2})) as j) group by i, j),
rows_ as (select i, list(s order by j) as r from cells group by i),
gauss as (select 1 as k, list(r order by i) as a from rows_
  union all select k + 1, list_transform(a, lambda r, i: case when i = k then list_transform(r, lambda v: v / a[k][k]) else list_transform(r, lambda v, j: v - r[k] / a[k][k] * a[k][j]) end)
  from gauss where k <= {n}),
beta as (select list_transform(a, lambda r: r[{n + 1}]) as b from gauss where k = {n + 1}),
learned as (select pair_id, list_dot_product(x[1:{n}], b) as score from wide, beta)"""


def score_sql(lng: list[str], tail: str) -> str:
    """All metrics of ``lng`` as ``scores(pair_id, row_id, label, metric, score)``, then ``tail``."""
    every = " union all ".join(f"select pair_id, '{m}' as metric, score from {m}" for m in (*FEATURES, "learned"))
    return ("with recursive " + ",\n".join([*lng, token_ctes(), rouge_ctes(), meteor_ctes(), vector_ctes(), learned_ctes()])
            + f",\nscores as (select lng.pair_id, row_id, label, metric, score from lng join ({every}) using (pair_id))\n{tail}").replace(")\n, st as", "),\nst as")
