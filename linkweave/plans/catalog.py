"""All queries over the driver's tables, with their SQL for DuckDB.

Roles: documents of ``src0`` are the first source and others the targets, their language is the group; scored pairs are
lineitems with a score made of their keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkweave.functions import similarity as sim
from linkweave.functions import tables
from linkweave.functions import text as tx
from linkweave.operators import adapt, blocking, context, decide, dense, evaluate, features, learn, records, sparse, validate
from linkweave.plans import linkage
from linkweave.runtime import apart, fresh_path, settle
from linkweave.sources import tables as src
from linkweave.streaming.incremental import unscored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def _read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _r(c, name=None):
    out = F.round(c, 6)
    return out.alias(name) if name else out


# ---- text ----------------------------------------------------------------------------------------------------------

#: What base() does to Latin text, in SQL.
def _base_sql(c: str) -> str:
    c = f"translate(coalesce({c}, ''), '°ºª', '   ')"
    for a, b in (("№", " no "), ("ß", "ss"), ("æ", "ae"), ("Æ", "ae"), ("œ", "oe"), ("Œ", "oe"), ("ø", "o"), ("Ø", "o"), ("ł", "l"), ("Ł", "l"), ("đ", "d"), ("Đ", "d")):
        c = f"replace({c}, '{a}', '{b}')"
    return f"trim(regexp_replace(replace(replace(lower(strip_accents({c})), '&', ' and '), '''', ''), '[^a-z0-9]+', ' ', 'g'))"


_TOK = "list_filter(string_split({}, ' '), lambda t: t <> '')"
_DOC_TOK = _TOK.format(_base_sql("text"))


@query(f"SELECT doc_id, {_base_sql('text')} AS base FROM documents")
def normalize_base(spark, sf_dir):
    """whole texts as lower-case ASCII words."""
    return _read(spark, sf_dir, "documents").select("doc_id", tx.base(F.col("text")).alias("base"))


_MERGED_SQL = """list_reduce(list_transform(
    list_zip({t}, range(len({t}))), lambda x: {{'s': x[1], 'one': regexp_full_match(x[1], '[a-z]')}}),
    lambda a, b: {{'s': a.s || CASE WHEN a.one AND b.one THEN '' ELSE ' ' END || b.s, 'one': b.one}}).s"""


@query("""
WITH t AS (SELECT conv_id, turn, """ + _TOK.format(_base_sql("text")) + """ AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN len(t) = 0 THEN '' ELSE """ + _MERGED_SQL.format(t="t") + """ END AS merged FROM t""")
def merge_initials(spark, sf_dir):
    """runs of single letters become a word."""
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", tx.merge_initials(tx.base(F.col("text"))).alias("merged"))


@query("""SELECT page_id, regexp_extract(lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)), '^\\s*(?:https?://)?(?:www\\.)?([a-z0-9][a-z0-9-]*)\\.(?:com|net|org|in|co|fr|biz|info|us|io)(?:\\.[a-z][a-z])?\\s*$', 1) AS stem FROM pages""")
def domain_stem(spark, sf_dir):
    """F8: names that are a domain."""
    host = F.lower(F.regexp_extract("url", r"^(https?://[^/?#]+)", 1))
    return _read(spark, sf_dir, "pages").select("page_id", tx.domain_stem(host).alias("stem"))


@query("""
WITH t AS (SELECT page_id, """ + _TOK.format("trim(regexp_replace(regexp_replace(" + _base_sql("url") + ", '([0-9])([a-z])', '\\1 \\2', 'g'), '([a-z])([0-9])', '\\1 \\2', 'g'))") + """ AS t FROM pages),
n AS (SELECT page_id, list_filter(t, lambda x: regexp_full_match(x, '[0-9]+')) AS n FROM t)
SELECT page_id, array_to_string(n, ' ') AS nums, coalesce(list_filter(n, lambda x: length(x) >= 5)[-1], '') AS zip FROM n""")
def numbers_and_zip(spark, sf_dir):
    """numbers in order and the last of five digits or more."""
    parted = F.regexp_replace(tx.base(F.col("url")), r"(?<=[0-9])(?=[a-z])|(?<=[a-z])(?=[0-9])", " ")
    n = tx.numbers(tx.tokens(parted))
    return _read(spark, sf_dir, "pages").select("page_id", F.array_join(n, " ").alias("nums"), tx.zip_of(n).alias("zip"))


#: Raw names and addresses as they come, made of parts: legal forms, aliases, domains, web sites, phones, regions, states.
#: The text is SQL that both engines read.
_RAW_NAME = """CASE p_partkey % 13 WHEN 0 THEN p_name || ' Private Limited' WHEN 1 THEN 'M/s ' || p_name || ' Trading'
  WHEN 2 THEN p_name || ' Ltd doing business as New ' || p_name || ' Services Inc' WHEN 3 THEN p_name || ' | www.' || replace(p_name, ' ', '') || '.com (ID: ' || p_partkey || ')'
  WHEN 4 THEN replace(p_name, ' ', '') || '.co.in' WHEN 5 THEN p_name || ' +91 98765-43210' WHEN 6 THEN 'L.L.C. ' || p_name || ' & Sons Limited Limited'
  WHEN 7 THEN 'The Of' WHEN 8 THEN 'Old ' || p_name || ' Pvt d/b/a ' WHEN 9 THEN upper(p_name) || ' S.A.R.L. f/k/a Société ' || p_name
  WHEN 10 THEN 'https://www.' || replace(p_name, ' ', '') || '.org' WHEN 11 THEN 'Sainte ' || p_name || ' n16 House Number 4 Formerly Known As Ste ' || p_brand || ' LLP' ELSE NULL END"""
_RAW_ADDRESS = """CASE p_partkey % 11 WHEN 0 THEN p_partkey || 'b Main Street, sector5' WHEN 1 THEN 'N° ' || (p_partkey % 90 + 1) || ' Rue de la Paix, 59000 Lille, Nord'
  WHEN 2 THEN 'House No ' || p_partkey || ', MG Road, Mumbai, Maharashtra 400001' WHEN 3 THEN 'Post Office Box 12, New York, New York 10001-2345'
  WHEN 4 THEN '28 B Quai St Michel, Île-de-France' WHEN 5 THEN 'Door No 5, P O Nagar, West Bengal, 0' || p_partkey WHEN 6 THEN p_partkey || ' Hauts-de-France Avenue, Texas'
  WHEN 7 THEN '12 T Crs Foch App 3, Bouches-du-Rhône' WHEN 8 THEN 'Flat 3 Apartment ' || p_partkey || ', Tamil Nadu 600 001' WHEN 9 THEN '  ' ELSE NULL END"""


def _map_sql(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in table.items()) + "}"


def _list_sql(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _phrases_sql(c: str) -> str:
    for pattern, to in tables.PHRASES:
        c = f"regexp_replace({c}, '{pattern[:-6]}([0-9])', '{to}\\1', 'g')" if pattern.endswith(r"(?=\d)") else f"regexp_replace({c}, '{pattern}', '{to}', 'g')"
    return c


def _names_sql(source: str) -> str:
    """CTEs up to ``names`` (id, raw, name_n, name_c, legal, name_alt, is_dom, tokens) from ``source`` (id, raw)."""
    alias = tables.ALIAS.removeprefix("(?i)")
    return f"""j AS (SELECT id, raw, trim(regexp_replace(regexp_replace(coalesce(raw, ''), '{tables.JUNK}', ' ', 'g'), '{tables.PHONE}', ' ', 'g'), ' |') AS j FROM {source}),
nd AS (SELECT id, raw, regexp_matches(j, '{tables.DOMAIN}') AS is_dom, CASE WHEN regexp_matches(j, '{tables.DOMAIN}') THEN regexp_extract(j, '{tables.DOMAIN}', 1) ELSE j END AS named FROM j),
sp AS (SELECT *, regexp_extract(named, '(?is)^(.*?){alias}(.*)$', 1) AS l, regexp_extract(named, '(?is)^(.*?){alias}(.*)$', 2) AS r FROM nd),
si AS (SELECT id, 0 AS part, CASE WHEN trim(r) <> '' THEN r ELSE named END AS s FROM sp UNION ALL SELECT id, 1, CASE WHEN trim(r) <> '' THEN l ELSE '' END FROM sp),
ph AS (SELECT id, part, {_TOK.format(_phrases_sql(_base_sql('s')))} AS t FROM si),
mi AS (SELECT id, part, CASE WHEN len(t) = 0 THEN [] ELSE string_split({_MERGED_SQL.format(t='t')}, ' ') END AS t FROM ph),
mp AS (SELECT id, part, list_transform(t, lambda x: coalesce({_map_sql(tables.NAME_WORDS)}[x], x)) AS t FROM mi),
ms AS (SELECT id, part, CASE WHEN len(t) > 1 AND t[1] = 'ms' THEN t[2:] ELSE t END AS t FROM mp),
co AS (SELECT id, part, list_filter(t, lambda x, i: i = 1 OR x <> t[i - 1]) AS t FROM ms),
cr AS (SELECT id, part, t, list_filter(t, lambda x: NOT list_contains({_list_sql(tables.NAME_DROP)}, x)) AS c FROM co),
names AS (SELECT sp.id, raw, array_to_string(a.t, ' ') AS name_n, array_to_string(CASE WHEN len(a.c) = 0 THEN a.t ELSE a.c END, ' ') AS name_c,
  array_to_string(list_sort(list_distinct(list_filter(a.t, lambda x: list_contains({_list_sql(tables.LEGAL)}, x)))), ' ') AS legal, array_to_string(b.c, ' ') AS name_alt, is_dom, a.t AS tokens
  FROM sp JOIN cr a ON a.id = sp.id AND a.part = 0 JOIN cr b ON b.id = sp.id AND b.part = 1)"""


def _addresses_sql(source: str) -> str:
    """CTEs up to ``addrs`` (id, tokens, nums, zip, addr_n, addr_fr) from ``source`` (id, raw)."""
    plain = "lower(strip_accents(trim(x)))"
    key = f"trim(regexp_replace({plain}, '[\\s\\-''’.]+', ' ', 'g'))"
    regions = "b"
    for name, code in sorted(tx._REGION_CODES.items(), key=lambda kv: -len(kv[0])):
        regions = f"regexp_replace({regions}, '\\b{name}\\b', '{code}', 'g')"
    states = _phrases_sql(regions)
    for name, code in sorted(tx._STATE_PHRASES.items(), key=lambda kv: -len(kv[0])):
        states = f"regexp_replace({states}, '\\b{name}\\b', '{code}', 'g')"
    admin = ", ".join("'" + k.replace("'", "''") + "': '" + v.replace("'", "''") + "'" for k, v in tx.ADMIN.items())
    digits = "regexp_full_match({}, '[0-9]+')"
    return f"""ca AS (SELECT id, array_to_string(list_transform(string_split(coalesce(raw, ''), ','), lambda x: coalesce(MAP {{{admin}}}[{key}], trim(x))), ', ') AS c FROM {source}),
cb AS (SELECT id, {_base_sql('c')} AS b FROM ca),
cs AS (SELECT id, regexp_replace(regexp_replace({states}, '([0-9])([a-z])', '\\1 \\2', 'g'), '([a-z])([0-9])', '\\1 \\2', 'g') AS s FROM cb),
ct AS (SELECT id, list_transform(list_filter(string_split(s, ' '), lambda x: x <> '' AND NOT list_contains({_list_sql(tables.ADDRESS_DROP)}, x)), lambda x: coalesce({_map_sql(tx._ADDRESS_WORDS)}[x], x)) AS t FROM cs),
cn AS (SELECT id, t, list_filter(t, lambda x: {digits.format('x')}) AS n, list_filter(t, lambda x, i: NOT (x = 'no' AND {digits.format("coalesce(t[i + 1], '')")})) AS k FROM ct),
addrs AS (SELECT id, t AS tokens, n AS numbers, array_to_string(t, ' ') AS addr_n, array_to_string(n, ' ') AS nums, coalesce(list_filter(n, lambda x: length(x) >= 5)[-1], '') AS zip,
  array_to_string(list_transform(list_transform(k, lambda x, i: CASE WHEN x IN ('b', 't') AND i > 1 AND {digits.format('k[i - 1]')} THEN CASE x WHEN 'b' THEN 'bis' ELSE 'ter' END ELSE x END), lambda x: coalesce({_map_sql(tables.FRENCH_WORDS)}[x], x)), ' ') AS addr_fr FROM cn)"""


_RAW = f"rn AS (SELECT p_partkey AS id, {_RAW_NAME} AS raw FROM part), ra AS (SELECT p_partkey AS id, {_RAW_ADDRESS} AS raw FROM part)"


def _raw(spark, sf_dir):
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr(_RAW_NAME).alias("name"), F.expr(_RAW_ADDRESS).alias("address"), "p_brand")


@query(f"WITH {_RAW}, {_names_sql('rn')} SELECT id, raw, name_n, name_c, legal, name_alt, is_dom FROM names")
def name_fields(spark, sf_dir):
    """A business name's canonical words, core, legal forms, alternative name, domain."""
    return _raw(spark, sf_dir).select("id", F.col("name").alias("raw"), tx.name_fields(F.col("name")).alias("f")).select("id", "raw", "f.*")


@query(f"WITH {_RAW}, {_addresses_sql('ra')} SELECT id, addr_n, nums, zip, addr_fr FROM addrs")
def address_fields(spark, sf_dir):
    """An address's canonical words, numbers, post code; French conventions beside them."""
    rows = _raw(spark, sf_dir).select("id", tx.address_fields(F.col("address")).alias("f"), tx.french_address(tx.address_tokens(F.col("address"))).alias("fr"))
    return rows.select("id", "f.*", F.array_join("fr", " ").alias("addr_fr"))


_SKEL = "x"
for _a, _b in (("ph", "f"), ("[ckq]", "k"), ("w", "v"), ("z", "j"), ("x", "ks")):
    _SKEL = f"regexp_replace({_SKEL}, '{_a}', '{_b}', 'g')"


@query(f"""
WITH w AS (SELECT doc_id, i, t[i] AS raw FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, {_DOC_TOK} AS t FROM documents))),
u AS (SELECT DISTINCT raw, CASE WHEN regexp_matches(raw, '[0-9]') AND regexp_matches(raw, '[a-z]') THEN translate(raw, '0134578', 'oleastb') ELSE raw END AS x FROM w),
s AS (SELECT raw, {_SKEL} AS y FROM u),
v AS (SELECT raw, CASE WHEN length(y) > 1 THEN substr(y, 1, 1) || regexp_replace(substr(y, 2), '[aeiouyh]', '', 'g') ELSE y END AS y FROM s),
q AS (SELECT raw, CASE WHEN regexp_full_match(raw, '[0-9]+') THEN raw ELSE
        array_to_string(list_transform(range(1, length(y) + 1), lambda i: CASE WHEN i > 1 AND substr(y, i, 1) = substr(y, i - 1, 1) THEN '' ELSE substr(y, i, 1) END), '') END AS z FROM v)
SELECT doc_id, string_agg(z, ' ' ORDER BY i) AS skeleton FROM w JOIN q USING (raw) GROUP BY doc_id""")
def skeleton(spark, sf_dir):
    """consonant skeletons of whole texts."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", tx.skeleton_text(tx.base(F.col("text"))).alias("skeleton"))
    return docs.filter("skeleton <> ''")


@query("""SELECT c_custkey, list_filter([regexp_replace(c_name, '[^0-9]', '', 'g')], lambda x: true)[1] AS digits,
  CASE WHEN ltrim(regexp_replace(c_name, '[^0-9]', '', 'g'), '0') = '' THEN '0' ELSE ltrim(regexp_replace(c_name, '[^0-9]', '', 'g'), '0') END AS plain FROM customer""")
def strip_zeros(spark, sf_dir):
    """numbers without leading zeros."""
    digits = F.regexp_replace("c_name", "[^0-9]", "")
    return _read(spark, sf_dir, "customer").select("c_custkey", digits.alias("digits"), tx.strip_zeros(digits).alias("plain"))


@query("""SELECT g, count(*) AS n FROM (SELECT unnest(list_transform(range(1, length(p) - 1), lambda i: substr(p, i, 3))) AS g
  FROM (SELECT ' ' || """ + _base_sql("p_name") + """ || ' ' AS p FROM part)) GROUP BY g""")
def char_grams(spark, sf_dir):
    """padded 3-grams of names, counted."""
    return _read(spark, sf_dir, "part").select(F.explode(tx.char_grams(tx.base(F.col("p_name")))).alias("g")).groupBy("g").agg(F.count("*").alias("n"))


def _skeleton_sql(word: str) -> str:
    x = f"CASE WHEN regexp_matches({word}, '[0-9]') AND regexp_matches({word}, '[a-z]') THEN translate({word}, '0134578', 'oleastb') ELSE {word} END"
    for pattern, to in (("ph", "f"), ("[ckq]", "k"), ("w", "v"), ("z", "j"), ("x", "ks")):
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    cut = f"list_transform([{x}], lambda y: substr(y, 1, 1) || regexp_replace(substr(y, 2), '[aeiouyh]', '', 'g'))"
    once = f"list_transform({cut}, lambda y: array_to_string(list_transform(range(1, length(y) + 1), lambda i: CASE WHEN i > 1 AND substr(y, i, 1) = substr(y, i - 1, 1) THEN '' ELSE substr(y, i, 1) END), ''))[1]"
    return f"CASE WHEN regexp_full_match({word}, '[0-9]+') THEN {word} ELSE {once} END"


_STRIP_SQL = "CASE WHEN ltrim(x, '0') = '' THEN '0' ELSE ltrim(x, '0') END"


@query(f"""WITH {_RAW}, {_names_sql('rn')}, {_addresses_sql('ra')},
b AS (SELECT n.id, string_split(name_c, ' ') AS n0, a.tokens AS a, numbers AS d, zip FROM names n JOIN addrs a USING (id)),
c AS (SELECT *, list_filter(n0, lambda x: x <> '') AS n, list_filter(a, lambda x: NOT regexp_full_match(x, '[0-9]+')) AS w, list_transform(d, lambda x: {_STRIP_SQL}) AS z FROM b),
e AS (SELECT *, list_transform(n, lambda x: {_skeleton_sql('x')}) AS k FROM c),
t AS (SELECT 2 AS version, unnest(list_concat(list_concat(list_transform(n, lambda x: 'n:' || x), list_transform(k, lambda x: 'k:' || x)), list_concat(list_concat(list_transform(w, lambda x: 'a:' || x), list_transform(z, lambda x: 'd:' || x)),
    CASE WHEN len(z) = 0 THEN [] ELSE list_transform(list_filter(w, lambda x: length(x) >= 3), lambda x: 'hs:' || z[1] || '_' || x) END))) AS token FROM e
  UNION ALL SELECT 1, unnest(list_concat(list_concat(list_transform(n, lambda x: 'n:' || x), list_transform(k, lambda x: 'k:' || x)), list_concat(list_transform(a, lambda x: 'a:' || x), list_concat(
    CASE WHEN len(d) = 0 THEN [] ELSE ['h:' || d[1] || '_' || coalesce(list_filter(a, lambda x: regexp_full_match(x, '[a-z]{{3,}}'))[1], '')] END, CASE WHEN zip = '' THEN [] ELSE ['z:' || zip, 'nz:' || coalesce(n[1], '') || '_' || zip] END)))) FROM e)
SELECT version, token, count(*) AS n FROM t GROUP BY 1, 2""")
def typed_tokens(spark, sf_dir):
    """typed blocking tokens of both versions, with how often each occurs."""
    fields = _raw(spark, sf_dir).select(tx.name_fields(F.col("name")).alias("f"), tx.address_tokens(F.col("address")).alias("a"))
    rows = fields.select(tx.tokens(F.col("f.name_c")).alias("n"), "a").withColumns({"k": tx.skeleton(F.col("n")), "d": tx.numbers(F.col("a"))})
    one = tx.typed_tokens_v1(F.col("n"), F.col("k"), F.col("a"), F.col("d"), tx.zip_of(F.col("d")))
    two = tx.typed_tokens(F.col("n"), F.col("k"), F.col("a"))
    of = lambda v, t: F.transform(t, lambda x: F.struct(F.lit(v).alias("version"), x.alias("token")))
    both = F.explode(F.concat(of(1, one), of(2, two))).alias("x")
    return rows.select(both).groupBy("x.version", "x.token").agg(F.count("*").alias("n"))


# ---- sparse retrieval ------------------------------------------------------------------------------------------------

#: Targets of a language that a token may be in. The operator's default suits names; whole texts share far more words.
_MAX_DF = 50


def _docs(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("grp"), "source", tx.tokens(tx.base(F.col("text"))).alias("tokens"))


def _sides(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return docs.filter("source = 'src0'"), docs.filter("source <> 'src0'")


_D = f"d AS (SELECT doc_id AS id, lang AS grp, source, {_DOC_TOK} AS tokens FROM documents)"


def _df_sql(where: str, name: str) -> str:
    return f"""{name} AS (SELECT grp, token, df, n, df / n AS share FROM
      (SELECT grp, token, count(*) AS df FROM (SELECT grp, unnest(list_distinct(tokens)) AS token FROM d WHERE {where}) GROUP BY 1, 2)
      JOIN (SELECT grp, count(*) AS n FROM d WHERE {where} GROUP BY 1) USING (grp))"""


@query(f"WITH {_D}, {_df_sql('true', 'f')} SELECT grp, token, df, n, round(share, 6) AS share FROM f")
def doc_frequency(spark, sf_dir):
    """A1, A2: document frequency by group."""
    return sparse.document_frequency(_docs(spark, sf_dir)).withColumn("share", _r("share"))


def _filler_sql(tail: str) -> str:
    latin = "FROM (SELECT grp, source, list_filter(tokens, lambda t: NOT regexp_full_match(t, '[0-9]+')) AS tokens FROM d0)"
    return f"""WITH {_D.replace('d AS', 'd0 AS', 1)}, d AS (SELECT * {latin}),
    {_df_sql("source = 'src0'", 'a')}, {_df_sql("source <> 'src0'", 'b')},
    m AS (SELECT grp, token, coalesce(a.share, 1e-6) AS f1, coalesce(b.share, 1e-6) AS f2 FROM a FULL JOIN b USING (grp, token)) {tail}"""


@query(_filler_sql("SELECT grp, token, round(f1, 6) AS f1, round(f2, 6) AS f2 FROM m WHERE f2 >= 0.001 AND f2 >= 1.8 * f1"))
def fillers(spark, sf_dir):
    """Tokens much more frequent among targets."""
    found = sparse.fillers(*_sides(spark, sf_dir))
    return found.select("grp", "token", _r("f1", "f1"), _r("f2", "f2"))


@query(_filler_sql(""", s AS (SELECT grp, median(f2 / f1) AS shrink FROM m WHERE f1 > 0.005 GROUP BY grp)
SELECT grp, token, round(f1, 6) AS f1, round(f2, 6) AS f2, round(coalesce(shrink, 1.0), 6) AS shrink FROM m LEFT JOIN s USING (grp)
WHERE f2 - coalesce(shrink, 1.0) * f1 >= 0.004 AND f2 >= 1.15 * coalesce(shrink, 1.0) * f1"""))
def excess_fillers(spark, sf_dir):
    """The same against the median ratio of common tokens."""
    found = sparse.excess_fillers(*_sides(spark, sf_dir))
    return found.select("grp", "token", _r("f1", "f1"), _r("f2", "f2"), _r("shrink", "shrink"))


_WEIGHTS = f"""{_D}, {_df_sql("source <> 'src0'", 'f')},
i AS (SELECT grp, token, ln((1 + n) / (1 + df)) + 1 AS idf FROM f WHERE df <= {_MAX_DF}),
tf AS (SELECT source, grp, id, token, count(*) AS tf FROM (SELECT source, grp, id, unnest(tokens) AS token FROM d) GROUP BY ALL),
w0 AS (SELECT source, grp, id, token, (1 + ln(tf)) * idf AS w FROM tf JOIN i USING (grp, token)),
w AS (SELECT source, grp, id, token, w / sqrt(sum(w * w) OVER (PARTITION BY grp, id)) AS w FROM w0)"""


def _weights(spark, sf_dir):
    return sparse.fitted(*_sides(spark, sf_dir), _MAX_DF)


@query(f"WITH {_WEIGHTS} SELECT grp, id, token, round(w, 6) AS w FROM w")
def tfidf_weights(spark, sf_dir):
    """Normalised weights of both sides, by the targets' frequencies."""
    first, targets = _weights(spark, sf_dir)
    return first.unionByName(targets).select("grp", "id", "token", _r("w", "w"))


_SCORED = f"""{_WEIGHTS}, s AS (SELECT a.grp, a.id AS q, b.id AS d, sum(a.w * b.w) AS score FROM w a JOIN w b ON a.grp = b.grp AND a.token = b.token
  WHERE a.source = 'src0' AND b.source <> 'src0' GROUP BY ALL),
r AS (SELECT grp, q, d, score, row_number() OVER (PARTITION BY grp, q ORDER BY round(score, 9) DESC, d) - 1 AS rank FROM s WHERE score > 1e-6)"""


@query(f"WITH {_SCORED} SELECT grp, q, d, round(score, 6) AS score, rank FROM r WHERE rank < 25")
def sparse_topk(spark, sf_dir):
    """The 25 best targets by shared tokens."""
    top = sparse.top_k(sparse.similarity(*_weights(spark, sf_dir)), 25)
    return top.select("grp", "q", "d", _r("score", "score"), F.col("rank").cast("long").alias("rank"))


_PAIRS_SQL = "p AS (SELECT a.grp, a.id AS q, b.id AS d FROM d a JOIN d b ON a.grp = b.grp AND b.id = a.id + 1 WHERE a.source = 'src0' AND b.source <> 'src0')"


@query(f"WITH {_WEIGHTS}, {_PAIRS_SQL}, s AS (SELECT a.grp, a.id AS q, b.id AS d, sum(a.w * b.w) AS score FROM w a JOIN w b ON a.grp = b.grp AND a.token = b.token AND b.id = a.id + 1 GROUP BY ALL) SELECT grp, q, d, round(coalesce(score, 0), 6) AS score FROM p LEFT JOIN s USING (grp, q, d)")
def pair_cosine(spark, sf_dir):
    """Scores of given pairs."""
    first, targets = _sides(spark, sf_dir)
    pairs = first.select("grp", F.col("id").alias("q"), (F.col("id") + 1).alias("d")).join(targets.select("grp", F.col("id").alias("d")), ["grp", "d"], "left_semi")
    return sparse.pair_cosine(pairs, *_weights(spark, sf_dir)).select("grp", "q", "d", _r("score", "score"))


# ---- dense retrieval -------------------------------------------------------------------------------------------------


def _vectors(spark, sf_dir):
    v = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("grp"), F.col("embedding").alias("vec"))
    return v.filter("id % 50 = 0"), v


def _turned(top):
    return top.select("grp", F.col("q").alias("d"), F.col("d").alias("q"), "score", "rank")


_DENSE = """s AS (SELECT a.label AS grp, a.vec_id AS q, b.vec_id AS d,
  list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a JOIN embeddings b USING (label) WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY grp, q ORDER BY round(score, 9) DESC, d) - 1 AS rank FROM s)"""


@query(f"WITH {_DENSE} SELECT grp, q, d, round(score, 6) AS score, rank FROM r WHERE rank < 10")
def dense_topk(spark, sf_dir):
    """Exact nearest neighbours in a group, of every vector whose id is divisible by 50."""
    top = dense.top_k(*_vectors(spark, sf_dir), 10)
    return top.select("grp", "q", "d", _r("score", "score"), F.col("rank").cast("long").alias("rank"))


_REVERSE = """v AS (SELECT b.label AS grp, b.vec_id AS d, a.vec_id AS q, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score
  FROM embeddings a JOIN embeddings b USING (label) WHERE a.vec_id % 50 = 0),
rv AS (SELECT *, row_number() OVER (PARTITION BY grp, d ORDER BY round(score, 9) DESC, q) - 1 AS rank FROM v)"""


@query(f"WITH {_REVERSE} SELECT grp, d, q, round(score, 6) AS score, rank FROM rv WHERE rank < 5")
def reverse_topk(spark, sf_dir):
    """R1 reversed: each target's nearest queries."""
    q, d = _vectors(spark, sf_dir)
    top = _turned(dense.top_k(d, q, 5))
    return top.select("grp", "d", "q", _r("score", "score"), F.col("rank").cast("long").alias("rank"))


@query("""SELECT a.vec_id AS q, b.vec_id AS d, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def pair_dot(spark, sf_dir):
    """Scores of given vector pairs."""
    _, v = _vectors(spark, sf_dir)
    return dense.pair_dot(v.select(F.col("id").alias("q"), (F.col("id") + 1).alias("d")), v, v).withColumn("score", _r("score"))


_GRAMS_SQL = "list_transform(range(1, length(' ' || p_name || ' ') - 1), lambda i: substr(' ' || p_name || ' ', i, 3))"
_VEC_SQL = """v AS (SELECT p_partkey AS id, k, count(*) AS c FROM (SELECT p_partkey, (('0x' || substr(md5(unnest(""" + _GRAMS_SQL + """)), 1, 8))::UBIGINT % 64) AS k FROM part) GROUP BY 1, 2),
l AS (SELECT id, sqrt(sum(c * c)) AS l FROM v GROUP BY 1)"""
_HYBRID = f"""{_VEC_SQL},
pt AS (SELECT p_partkey AS id, p_brand AS grp, string_split(p_name || ' ' || lower(p_type) || ' ' || p_size, ' ') AS tokens FROM part),
pf AS (SELECT grp, token, count(*) AS df FROM (SELECT grp, unnest(list_distinct(tokens)) AS token FROM pt) GROUP BY 1, 2 HAVING count(*) <= 40),
pn AS (SELECT grp, count(*) AS n FROM pt GROUP BY 1),
pw0 AS (SELECT grp, id, token, (1 + ln(count(*))) * any_value(ln((1 + n) / (1 + df)) + 1) AS w FROM (SELECT grp, id, unnest(tokens) AS token FROM pt) JOIN pf USING (grp, token) JOIN pn USING (grp) GROUP BY 1, 2, 3),
pw AS (SELECT grp, id, token, w / sqrt(sum(w * w) OVER (PARTITION BY grp, id)) AS w FROM pw0),
al AS (SELECT a.grp, a.id AS q, b.id AS d FROM pt a JOIN pt b USING (grp) WHERE a.id % 50 = 0),
ds0 AS (SELECT a.id AS q, b.id AS d, sum(a.c * b.c) / any_value(x.l * y.l) AS s FROM v a JOIN v b ON a.k = b.k JOIN l x ON x.id = a.id JOIN l y ON y.id = b.id WHERE a.id % 50 = 0 GROUP BY 1, 2),
ss0 AS (SELECT a.id AS q, b.id AS d, sum(a.w * b.w) AS s FROM pw a JOIN pw b ON a.grp = b.grp AND a.token = b.token WHERE a.id % 50 = 0 GROUP BY 1, 2),
sc AS (SELECT grp, al.q, al.d, coalesce(x.s, 0) AS dense_s, y.s AS sparse0, coalesce(y.s, 0) AS sparse_s FROM al LEFT JOIN ds0 x USING (q, d) LEFT JOIN ss0 y USING (q, d)),
rk AS (SELECT *, row_number() OVER (PARTITION BY grp, q ORDER BY round(dense_s, 9) DESC, d) - 1 AS fr, row_number() OVER (PARTITION BY grp, d ORDER BY round(dense_s, 9) DESC, q) - 1 AS br,
  CASE WHEN sparse0 > 1e-6 THEN row_number() OVER (PARTITION BY grp, q ORDER BY round(coalesce(sparse0, -1), 9) DESC, d) - 1 END AS sr FROM sc),
un AS (SELECT q, d, CASE WHEN fr < 10 THEN fr END AS dense_r, CASE WHEN br < 2 THEN br END AS rdense_r, CASE WHEN sr < 6 THEN sr END AS sparse_r, dense_s, sparse_s FROM rk WHERE fr < 10 OR br < 2 OR sr < 6),
hy AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(dense_s, 9) DESC, d) - 1 AS dense_r2, row_number() OVER (PARTITION BY q ORDER BY round(sparse_s, 9) DESC, d) - 1 AS sparse_r2 FROM un)"""


def _hybrid(spark, sf_dir):
    """All pairs of the three paths, with both exact scores and both ranks: parts divisible by 50 against all of their brand."""
    # parts are dealt by id first: a small file is few tasks
    parts = _read(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_name", "p_type", "p_size").repartition("p_partkey").select(
        F.col("p_brand").alias("grp"), F.col("p_partkey").alias("id"), tx.char_grams(F.col("p_name")).alias("grams"),
        F.split(F.concat_ws(" ", "p_name", F.lower("p_type"), F.col("p_size").cast("string")), " ").alias("words"),
    )
    vectors = settle(dense.hashed_vectors(parts.select("grp", "id", F.col("grams").alias("tokens"))).select("grp", "id", "vec"), "vectors")
    texts = parts.select("grp", "id", F.col("words").alias("tokens"))
    asked = F.col("id") % 50 == 0
    q, d = vectors.filter(asked), vectors
    wq, wd = sparse.fitted(texts.filter(asked), texts, 40)
    paths = {"dense": dense.top_k(q, d, 10), "rdense": _turned(dense.top_k(d, q, 2)), "sparse": sparse.top_k(sparse.similarity(wq, wd), 6)}
    groups = apart(vectors.select("grp", F.col("id").alias("q")))
    pairs = settle(dense.pair_dot(blocking.union_paths(paths), q, d).withColumnRenamed("score", "dense_s").join(groups, "q"), "dense-pairs")
    cosines = sparse.pair_cosine(pairs.select("grp", "q", "d"), wq, wd).select("q", "d", F.col("score").alias("sparse_s"))
    pairs = settle(pairs.join(apart(cosines), ["q", "d"]), "scored-pairs")
    return blocking.rank_within(blocking.rank_within(pairs, ["q"], "dense_s", "dense_r2"), ["q"], "sparse_s", "sparse_r2")


@query(f"""WITH {_HYBRID} SELECT q, d, dense_r, rdense_r, sparse_r, round(dense_s, 6) AS dense_s, round(sparse_s, 6) AS sparse_s, dense_r2, sparse_r2 FROM hy
  WHERE dense_r2 < 5 OR sparse_r2 < 3 OR rdense_r = 0""")
def hybrid_candidates(spark, sf_dir):
    """Dense, reverse and sparse paths, both exact scores, ranks and the rule."""
    kept = blocking.apply_rule(_hybrid(spark, sf_dir), 5, 3)
    return kept.select("q", "d", "dense_r", "rdense_r", "sparse_r", _r("dense_s", "dense_s"), _r("sparse_s", "sparse_s"), "dense_r2", "sparse_r2")


@query(f"""WITH {_HYBRID}, tr AS (SELECT a.p_partkey AS q, b.p_partkey AS d FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_name = b.p_name WHERE a.p_partkey % 50 = 0 AND a.p_partkey <> b.p_partkey),
nt AS (SELECT count(*) AS total FROM tr), nq AS (SELECT count(DISTINCT q) AS queries FROM hy),
gr AS (SELECT cd, cs, h.*, tr.q IS NOT NULL AS y FROM hy h LEFT JOIN tr ON tr.q = h.q AND tr.d = h.d, (VALUES (2), (5), (8)) a(cd), (VALUES (0), (3), (5)) b(cs))
SELECT cd, cs, round(coalesce(count(CASE WHEN y AND (dense_r2 < cd OR sparse_r2 < cs OR rdense_r = 0) THEN 1 END) / nullif(any_value(total), 0), 0), 6) AS recall,
  round(count(CASE WHEN dense_r2 < cd OR sparse_r2 < cs OR rdense_r = 0 THEN 1 END) / any_value(queries), 6) AS per_query FROM gr, nt, nq GROUP BY cd, cs""")
def blocking_rule_grid(spark, sf_dir):
    """Recall and size of the rule for a grid of both ranks' caps; parts of one name are each other's truth."""
    parts = _read(spark, sf_dir, "part").select("p_brand", "p_name", "p_partkey")
    truth = parts.filter("p_partkey % 50 = 0").withColumnRenamed("p_partkey", "q").join(apart(parts.withColumnRenamed("p_partkey", "d")), ["p_brand", "p_name"]).filter("q <> d").select("q", "d")
    return blocking.rule_grid(_hybrid(spark, sf_dir), truth, [2, 5, 8], [0, 3, 5]).withColumns({c: _r(c) for c in ("recall", "per_query")})


@query(f"""WITH {_SCORED}, t AS (SELECT q, d FROM r WHERE rank IN (0, 3)), n AS (SELECT count(*) AS total FROM t),
c AS (SELECT cap, r.q, r.d, r.rank, t.q IS NOT NULL AS is_true FROM r LEFT JOIN t ON t.q = r.q AND t.d = r.d, (VALUES (1), (5), (25)) v(cap) WHERE r.rank < 25)
SELECT cap, round(sum(CASE WHEN rank < cap AND is_true THEN 1 ELSE 0 END) / any_value(total), 6) AS recall,
  round(sum(CASE WHEN rank < cap THEN 1 ELSE 0 END) / count(DISTINCT q), 6) AS per_query FROM c, n GROUP BY cap""")
def blocking_recall_grid(spark, sf_dir):
    """Recall and size for a grid of caps."""
    top = sparse.top_k(sparse.similarity(*_weights(spark, sf_dir)), 25)
    return blocking.recall_grid(top, top.filter("rank IN (0, 3)"), "rank", [1, 5, 25]).withColumns({c: _r(c) for c in ("recall", "per_query")})


# ---- competition and decisions ---------------------------------------------------------------------------------------

_P = """pairs AS (SELECT DISTINCT l_orderkey AS s1, 2 + l_linenumber % 2 AS src, l_partkey AS tgt,
  ((l_orderkey * 7919 + l_partkey * 104729) % 1000) / 1000 AS p FROM lineitem)"""


def _pairs(spark, sf_dir, *by):
    p = ((F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729) % 1000) / 1000
    pairs = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("s1"), (2 + F.col("l_linenumber") % 2).alias("src"), F.col("l_partkey").alias("tgt"), p.alias("p"))
    return (pairs.repartition(*by) if by else pairs).distinct()


@query(f"""WITH {_P} SELECT s1, src, tgt, p,
 max(p) OVER a AS c_s1max, round(p - max(p) OVER a, 6) AS c_s1gap, row_number() OVER (PARTITION BY s1, src ORDER BY p DESC, tgt) AS c_s1rank, count(*) OVER a AS c_s1n,
 max(p) OVER b AS c_tmax, round(p - max(p) OVER b, 6) AS c_tgap, row_number() OVER (PARTITION BY src, tgt ORDER BY p DESC, s1) AS c_trank, count(*) OVER b AS c_tn
 FROM pairs WINDOW a AS (PARTITION BY s1, src), b AS (PARTITION BY src, tgt)""")
def group_context(spark, sf_dir):
    """Eight columns of competition."""
    return context.group_context(_pairs(spark, sf_dir), "p", "c").withColumns({c: _r(c) for c in ("c_s1gap", "c_tgap")})


@query(f"""WITH {_P}, r AS (SELECT *, row_number() OVER (PARTITION BY s1, src ORDER BY p DESC, tgt) AS ra, row_number() OVER (PARTITION BY src, tgt ORDER BY p DESC, s1) AS rb FROM pairs)
SELECT s1, src, tgt, p, round(sum(p) OVER (PARTITION BY s1), 6) AS s1sum_all,
 sum(CASE WHEN p > 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY s1)::BIGINT AS s1cnt50_all,
 coalesce(CASE WHEN src = 2 THEN max(CASE WHEN src = 3 THEN p END) OVER (PARTITION BY s1) ELSE max(CASE WHEN src = 2 THEN p END) OVER (PARTITION BY s1) END, -1.0) AS other_max,
 sum(CASE WHEN p > 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY s1, src)::BIGINT AS s1cnt50,
 round(p - CASE WHEN ra = 1 THEN coalesce(max(CASE WHEN ra = 2 THEN p END) OVER (PARTITION BY s1, src), 0) ELSE max(p) OVER (PARTITION BY s1, src) END, 6) AS s1margin,
 round(p - CASE WHEN rb = 1 THEN coalesce(max(CASE WHEN rb = 2 THEN p END) OVER (PARTITION BY src, tgt), 0) ELSE max(p) OVER (PARTITION BY src, tgt) END, 6) AS tmargin FROM r""")
def competition_context(spark, sf_dir):
    """Sums, counts, margins, the best elsewhere."""
    return context.competition_context(_pairs(spark, sf_dir)).withColumns({c: _r(c) for c in ("s1sum_all", "s1margin", "tmargin")})


@query("SELECT p_partkey, p_name, p_brand, count(*) OVER (PARTITION BY p_name, p_brand) AS freq FROM part")
def name_frequency(spark, sf_dir):
    """How often a name occurs in its group."""
    return context.name_frequency(_read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), ["p_name", "p_brand"])


@query(f"""WITH {_P}, n AS (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY src, tgt) - 1 AS i, count(*) OVER (PARTITION BY s1) AS n FROM pairs)
SELECT o_orderkey AS s1, o_custkey AS u, src, tgt, p, n FROM orders JOIN n ON s1 = o_orderkey AND o_custkey % n = i""")
def pick_negative(spark, sf_dir):
    """The (u mod n)-th pair."""
    wanted = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("s1"), F.col("o_custkey").alias("u"))
    return context.pick_negative(_pairs(spark, sf_dir), wanted)


_EXCL = f"{_P}, ex AS (SELECT s1, src, tgt, p FROM (SELECT *, row_number() OVER (PARTITION BY src, tgt ORDER BY p DESC, s1) AS n FROM pairs) WHERE n = 1)"


@query(f"WITH {_EXCL} SELECT * FROM ex")
def exclusive(spark, sf_dir):
    """Each target to its best claimant."""
    return decide.exclusive(_pairs(spark, sf_dir))


@query(f"WITH {_EXCL} SELECT * FROM ex WHERE p >= 0.7")
def threshold(spark, sf_dir):
    """D3 after D1."""
    return decide.threshold(decide.exclusive(_pairs(spark, sf_dir)), 0.7)


_EF = f"""{_EXCL}, k0 AS (SELECT *, row_number() OVER w AS k, sum(p) OVER (w ROWS UNBOUNDED PRECEDING) AS cs, sum(p) OVER (PARTITION BY s1) AS tot, product(1 - p) OVER (PARTITION BY s1) AS none
  FROM ex WHERE p >= 0.3 WINDOW w AS (PARTITION BY s1 ORDER BY p DESC, src, tgt)),
k1 AS (SELECT *, round(1.25 * cs / (k + 0.25 * tot), 12) AS ef FROM k0),
k2 AS (SELECT *, max(ef) OVER (PARTITION BY s1) AS best FROM k1),
k3 AS (SELECT *, min(CASE WHEN ef = best THEN k END) OVER (PARTITION BY s1) AS kb FROM k2),
ef AS (SELECT s1, src, tgt, p FROM k3 WHERE k <= kb AND p >= 0.6 AND best > none)"""


@query(f"WITH {_EF} SELECT * FROM ef")
def expected_f(spark, sf_dir):
    """The prefix with the best expected F0.5."""
    return decide.expected_f(decide.exclusive(_pairs(spark, sf_dir)))


@query(f"""WITH {_P}, o AS (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, src, tgt) AS k FROM pairs WHERE p >= 0.02),
l AS (SELECT s1, list(p ORDER BY k) AS p, count(*) AS n FROM o WHERE k <= 24 GROUP BY s1),
w AS (SELECT s1, p, n, m, list_product(list_transform(p, lambda x, i: CASE WHEN (m >> (i - 1)) & 1 = 1 THEN x ELSE 1 - x END)) AS w FROM (SELECT s1, p, n, unnest(range(0, 1 << n::INTEGER)) AS m FROM l)),
e AS (SELECT s1, k, round(sum(w * CASE WHEN bit_count(m & ((1 << k::INTEGER) - 1)) = 0 THEN 0 ELSE 1.25 * bit_count(m & ((1 << k::INTEGER) - 1)) / (1.25 * bit_count(m & ((1 << k::INTEGER) - 1)) + 0.25 * bit_count(m >> k::INTEGER) + k - bit_count(m & ((1 << k::INTEGER) - 1))) END), 11) AS v
  FROM (SELECT s1, m, w, unnest(range(1, n + 1)) AS k FROM w) GROUP BY 1, 2),
z AS (SELECT s1, k, v FROM e UNION ALL SELECT s1, 0, round(list_product(list_transform(p, lambda x: 1 - x)), 11) FROM l),
b AS (SELECT s1, min(k) AS best FROM z JOIN (SELECT s1, max(v) AS v FROM z GROUP BY 1) USING (s1, v) GROUP BY 1)
SELECT s1, src, tgt, p FROM o JOIN b USING (s1) WHERE k <= best""")
def exact_expected_f(spark, sf_dir):
    """The same by the Poisson-binomial distribution; the SQL adds up all outcomes."""
    return decide.exact_expected_f(_pairs(spark, sf_dir))


_TRUTH = "truth AS (SELECT s1, src, tgt FROM pairs WHERE (s1 + tgt) % 3 = 0)"
_ENTITY = f"""{_TRUTH},
e0 AS (SELECT s1, count(CASE WHEN a AND b THEN 1 END) AS tp, count(CASE WHEN a THEN 1 END) AS n_pred, count(CASE WHEN b THEN 1 END) AS n_true
  FROM (SELECT s1, x.s1 IS NOT NULL AS a, t.s1 IS NOT NULL AS b FROM ef x FULL JOIN truth t USING (s1, src, tgt)) GROUP BY s1),
e AS (SELECT s1, coalesce(tp, 0) AS tp, coalesce(n_pred, 0) AS n_pred, coalesce(n_true, 0) AS n_true FROM (SELECT o_orderkey AS s1 FROM orders) LEFT JOIN e0 USING (s1)),
f AS (SELECT *, CASE WHEN n_pred = 0 AND n_true = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE 1.25 * tp / (1.25 * tp + 0.25 * (n_true - tp) + n_pred - tp) END::DOUBLE AS f FROM e)"""


def _truth(pairs):
    return pairs.filter("(s1 + tgt) % 3 = 0")


def _entities(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    universe = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("s1"))
    return evaluate.per_entity(universe, decide.expected_f(decide.exclusive(pairs)), _truth(pairs))


@query(f"WITH {_EF}, {_ENTITY} SELECT s1, tp, n_pred, n_true, round(f, 6) AS f FROM f")
def entity_f05(spark, sf_dir):
    """F0.5 of each entity."""
    return _entities(spark, sf_dir).withColumn("f", _r("f"))


@query(f"WITH {_EF}, {_ENTITY} SELECT count(*) AS n, round(avg(f), 6) AS macro_f FROM f")
def macro_f05(spark, sf_dir):
    """The mean over the universe."""
    return evaluate.macro(_entities(spark, sf_dir)).withColumn("macro_f", _r("macro_f"))


@query(f"""WITH {_EXCL}, {_TRUTH}, g AS (SELECT t, s1, src, tgt FROM ex, (VALUES (0.4), (0.6), (0.8)) v(t) WHERE p >= t),
c AS (SELECT t, s1, count(*) AS n_pred, count(CASE WHEN (s1 + tgt) % 3 = 0 THEN 1 END) AS tp FROM g GROUP BY 1, 2),
n AS (SELECT s1, count(*) AS n_true FROM truth GROUP BY 1),
u AS (SELECT t, o_orderkey AS s1 FROM orders, (VALUES (0.4), (0.6), (0.8)) v(t)),
f AS (SELECT t, CASE WHEN coalesce(n_pred, 0) = 0 AND coalesce(n_true, 0) = 0 THEN 1.0 WHEN coalesce(tp, 0) = 0 THEN 0.0
  ELSE 1.25 * tp / (1.25 * tp + 0.25 * (n_true - tp) + n_pred - tp) END::DOUBLE AS f FROM u LEFT JOIN c USING (t, s1) LEFT JOIN n USING (s1))
SELECT t::DOUBLE AS t, round(avg(f), 6) AS macro_f FROM f GROUP BY t""")
def decision_grid(spark, sf_dir):
    """Every threshold's score in one job."""
    pairs, steps = _pairs(spark, sf_dir), [0.4, 0.6, 0.8]
    grid = decide.threshold_grid(decide.exclusive(pairs), steps)
    times = F.explode(F.array(*[F.lit(t) for t in steps])).alias("t")
    universe = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("s1"), times)
    # (t, s1) stands for the entity, so that one evaluation serves all thresholds
    both = lambda df: df.withColumn("s1", F.struct("t", "s1"))
    met = evaluate.per_entity(both(universe), both(grid), both(_truth(pairs).select("s1", "src", "tgt", times)))
    return met.groupBy(F.col("s1.t").alias("t")).agg(_r(F.avg("f"), "macro_f"))


@query(f"""WITH {_EF}, {_TRUTH}, m AS (SELECT x.s1 IS NOT NULL AS a, t.s1 IS NOT NULL AS b, p.p >= 0.1 AS c FROM ef x FULL JOIN truth t USING (s1, src, tgt) JOIN pairs p USING (s1, src, tgt))
SELECT count(CASE WHEN a AND b THEN 1 END) AS tp, count(CASE WHEN a AND NOT b THEN 1 END) AS fp, count(CASE WHEN b AND NOT a THEN 1 END) AS fn,
 count(CASE WHEN b AND NOT a AND NOT c THEN 1 END) AS fn_blocking, count(CASE WHEN b AND NOT a AND c THEN 1 END) AS fn_model FROM m""")
def error_breakdown(spark, sf_dir):
    """Where links are lost."""
    pairs = _pairs(spark, sf_dir)
    return evaluate.error_breakdown(decide.expected_f(decide.exclusive(pairs)), _truth(pairs), pairs.filter("p >= 0.1"))


@query(f"""WITH {_EF}, n AS (SELECT s1, count(*) AS n FROM ef GROUP BY 1)
SELECT o_orderpriority AS country, count(*) AS n_s1, round(avg(CASE WHEN n > 0 THEN 1 ELSE 0 END), 6) AS matched_share, round(avg(coalesce(n, 0)), 6) AS per_s1
FROM orders LEFT JOIN n ON s1 = o_orderkey GROUP BY 1""")
def country_report(spark, sf_dir):
    """Predictions by group."""
    universe = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("s1"), F.col("o_orderpriority").alias("country"))
    out = evaluate.report(universe, decide.expected_f(decide.exclusive(_pairs(spark, sf_dir))))
    return out.withColumns({c: _r(c) for c in ("matched_share", "per_s1")})


@query(f"""WITH {_P}, n AS (SELECT *, tgt % 4 = 0 AS near, sum(CASE WHEN tgt % 4 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY src, tgt) AS c FROM pairs)
SELECT s1, src, tgt, CASE WHEN (near AND c = 1) OR p > 0.995 THEN 1 WHEN p < 0.005 AND NOT near THEN 0 ELSE -1 END AS y FROM n""")
def pseudo_labels(spark, sf_dir):
    """Sure and unlikely pairs."""
    return adapt.pseudo_labels(_pairs(spark, sf_dir).withColumn("near", F.col("tgt") % 4 == 0)).select("s1", "src", "tgt", "y")


_PACK = f"{_EF}, pk AS (SELECT s1, src, tgt, max(score) AS score FROM (SELECT s1, src, tgt, p AS score FROM pairs WHERE p >= 0.1 UNION ALL SELECT s1, src, tgt, 2.0 FROM ef) GROUP BY ALL)"


def _package(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    return adapt.package(pairs, decide.expected_f(decide.exclusive(pairs)), 0.1)


@query(f"WITH {_PACK} SELECT s1, src, tgt, score FROM pk")
def package_candidates(spark, sf_dir):
    """Likely candidates and all matches."""
    return _package(spark, sf_dir)


@query(f"WITH {_PACK} SELECT s1, string_agg(id, ',' ORDER BY score DESC, id) AS ids FROM (SELECT s1, score, 'S' || src || '-' || tgt AS id FROM pk) GROUP BY s1")
def id_list(spark, sf_dir):
    """Ids by falling score."""
    return adapt.id_lists(_package(spark, sf_dir).withColumn("id", F.concat(F.lit("S"), F.col("src").cast("string"), F.lit("-"), F.col("tgt").cast("string"))))


_LISTS = """lists AS (SELECT o_orderkey AS s1, string_agg('S' || (1 + l_linenumber % 3) || '-' || l_partkey % 100, ',' ORDER BY l_linenumber, l_partkey) AS ids
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' GROUP BY 1),
x AS (SELECT s1, unnest(string_split(ids, ',')) AS id FROM lists)"""


def _lists(spark, sf_dir):
    ids = F.concat(F.lit("S"), (1 + F.col("l_linenumber") % 3).cast("string"), F.lit("-"), (F.col("l_partkey") % 100).cast("string"))
    lines = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("s1"), F.struct("l_linenumber", "l_partkey", ids.alias("id")).alias("x"))
    orders = _read(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("s1"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["id"]), ",")
    return lines.join(orders, "s1").groupBy("s1").agg(joined.alias("ids"))


@query(f"""WITH {_LISTS},
u AS (SELECT DISTINCT l_orderkey AS s1 FROM lineitem)
SELECT 'duplicate s1' AS rule, 0::BIGINT AS n, NULL::BIGINT AS sample
UNION ALL SELECT 'duplicate id', count(*), min(s1) FROM (SELECT s1, id FROM x GROUP BY 1, 2 HAVING count(*) > 1)
UNION ALL SELECT 'self match', count(*), min(s1) FROM x WHERE id LIKE 'S1-%'
UNION ALL SELECT 'wrong prefix', count(*), min(s1) FROM x WHERE id NOT SIMILAR TO 'S[123]-.*'
UNION ALL SELECT 'missing s1', count(*), min(s1) FROM u WHERE s1 NOT IN (SELECT s1 FROM lists)
UNION ALL SELECT 'unexpected s1', count(*), min(s1) FROM lists WHERE s1 NOT IN (SELECT s1 FROM u)
UNION ALL SELECT 'unknown id', count(*), min(s1) FROM x WHERE id NOT IN (SELECT 'S' || s || '-' || k FROM range(2, 4) a(s), range(0, 90) b(k))""")
def validate_rules(spark, sf_dir):
    """The output rules, a count and a sample of each."""
    universe = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("s1")).distinct()
    known = spark.range(90).select(F.explode(F.array(F.lit("S2-"), F.lit("S3-"))).alias("s"), "id").select(F.concat("s", F.col("id").cast("string")).alias("id"))
    return validate.validate(_lists(spark, sf_dir), universe, known)


@query(f"""WITH {_LISTS}, c AS (SELECT s1, list_filter(string_split(ids, ','), lambda z: z LIKE 'S2-%') AS c, string_split(ids, ',') AS i FROM lists),
o AS (SELECT s1, list_filter(i, lambda z: NOT list_contains(c, z)) AS m FROM c)
SELECT s1, array_to_string(list_filter(m, lambda z, k: list_position(m, z) = k), ',') AS ids FROM o WHERE len(m) > 0""")
def matches_outside_candidates(spark, sf_dir):
    """V2: matches that the candidates lack."""
    lists = _lists(spark, sf_dir)
    return validate.outside_candidates(lists, lists.withColumn("ids", F.array_join(F.filter(F.split("ids", ","), lambda x: x.startswith("S2-")), ",")))


@query(f"""WITH {_LISTS} SELECT x.s1, substr(id, 2, 1)::INTEGER AS src, id AS tgt FROM x
WHERE id IN (SELECT 'S' || s || '-' || k FROM range(1, 4) a(s), range(0, 90) b(k))""")
def explode_truth(spark, sf_dir):
    """Id lists as edges of known entities."""
    known = spark.range(90).select(F.explode(F.array(F.lit("S1-"), F.lit("S2-"), F.lit("S3-"))).alias("s"), "id").select(F.concat("s", F.col("id").cast("string")).alias("tgt"))
    lists = _lists(spark, sf_dir)
    return src.explode_truth(lists, lists, known)


@query(f"WITH {_P} SELECT s1, src, tgt, p FROM pairs WHERE (s1, src, tgt) NOT IN (SELECT (s1, src, tgt) FROM pairs WHERE p < 0.5)")
def incremental_pairs(spark, sf_dir):
    """Pairs that aren't scored yet."""
    pairs = _pairs(spark, sf_dir)
    return unscored(pairs, pairs.filter("p < 0.5"))


@query(f"""WITH {_P} SELECT (('0x' || substr(md5('42:' || s1), 1, 8))::UBIGINT % 10)::INTEGER AS fold, count(DISTINCT s1) AS n FROM pairs GROUP BY 1""")
def folds(spark, sf_dir):
    """M1: folds by key and seed."""
    return _pairs(spark, sf_dir).groupBy(learn.fold_of(F.col("s1"), 10).alias("fold")).agg(F.countDistinct("s1").alias("n"))


_FOLD_SQL = "(('0x' || substr(md5('42:' || s1), 1, 8))::UBIGINT % 10)::INTEGER"


@query(f"""WITH {_P}, f AS (SELECT DISTINCT s1, {_FOLD_SQL} AS fold FROM pairs)
SELECT fold, fold < 3 AS encoder, CASE WHEN fold >= 3 THEN (fold - 3) % 4 END AS cv, count(*) AS n FROM f GROUP BY ALL""")
def split_folds(spark, sf_dir):
    """M1: ten folds, those that encoders learn on, and the rankers' folds among the others."""
    return _pairs(spark, sf_dir).select("s1").distinct().select(learn.split(F.col("s1")).alias("s")).select("s.*").groupBy("fold", "encoder", "cv").agg(F.count("*").alias("n"))


@query(f"""WITH {_P}, {_TRUTH}, f AS (SELECT *, {_FOLD_SQL} AS fold FROM pairs),
m AS (SELECT DISTINCT s1 FROM f WHERE fold >= 3 ORDER BY md5('42:' || s1), s1 LIMIT 400)
SELECT s1, src, tgt, p, ((fold - 3) % 4)::INTEGER AS fold, ((s1 + tgt) % 3 = 0)::INTEGER AS y FROM f JOIN m USING (s1)""")
def training_rows(spark, sf_dir):
    """M2: the candidates of a number of first entities (a parameter) outside the encoders' folds, labelled."""
    pairs = _pairs(spark, sf_dir)
    return learn.label(pairs.join(learn.training_keys(pairs, 400), "s1"), _truth(pairs)).select("s1", "src", "tgt", "p", "fold", "y")


@query(f"""WITH {_EF}, {_ENTITY} SELECT round(avg(1 - f), 6) AS mean_loss, round(sum(CASE WHEN n_true = 0 THEN 1 - f ELSE 0 END) / sum(1 - f), 6) AS singletons_share,
  round(sum(CASE WHEN n_true > 0 AND n_pred = 0 THEN 1 - f ELSE 0 END) / sum(1 - f), 6) AS empty_share, round(sum(CASE WHEN n_true > 0 AND n_pred > 0 THEN 1 - f ELSE 0 END) / sum(1 - f), 6) AS partial_share FROM f""")
def loss_shares(spark, sf_dir):
    """E5: which entities the loss comes from."""
    out = evaluate.loss_shares(_entities(spark, sf_dir))
    return out.select(*[_r(c, c) for c in out.columns])


@query(f"""WITH {_EF}, {_TRUTH}, c AS (SELECT s1, src, tgt, p FROM pairs WHERE p >= 0.1),
a AS (SELECT 'false positive' AS kind, s1, src, tgt FROM ef ANTI JOIN truth USING (s1, src, tgt)), b AS (SELECT 'refused link' AS kind, t.* FROM truth t ANTI JOIN ef USING (s1, src, tgt) SEMI JOIN c USING (s1, src, tgt)),
d AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY md5('42:' || s1 || ':' || src || ':' || tgt), s1, src, tgt) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b))
SELECT kind, s1, src, tgt, p FROM d LEFT JOIN c USING (s1, src, tgt) WHERE n <= 10""")
def error_samples(spark, sf_dir):
    """E5: ten errors of each kind (the report's size) at random, with their scores."""
    pairs = _pairs(spark, sf_dir)
    return evaluate.error_samples(decide.expected_f(decide.exclusive(pairs)), _truth(pairs), pairs.filter("p >= 0.1"), 10)


@query("""SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer
UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier""")
def union_by_name(spark, sf_dir):
    """Rows of two sources by column name, columns that one lacks null there."""
    a = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    b = _read(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("id"))
    return records.union_sources(a, b)


@query("SELECT p_partkey, p_name, p_size, p_retailprice::FLOAT AS p_retailprice FROM part")
def parquet_round_trip(spark, sf_dir):
    """Doubles as floats, written to Parquet and read back."""
    path = fresh_path(spark, "parts")
    src.write_parquet(learn.as_floats(_read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")), path)
    return spark.read.parquet(path)


@query(f"SELECT p_partkey AS id, {_base_sql('p_name')} || ' || ' || {_base_sql('p_type')} AS ftext FROM part")
def full_text(spark, sf_dir):
    """what a pair scorer reads of a record."""
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), records.full_text(tx.base(F.col("p_name")), tx.base(F.col("p_type"))).alias("ftext"))


# ---- similarities ----------------------------------------------------------------------------------------------------

_NAMES = """n AS (SELECT a.p_partkey AS id, a.p_name AS a, b.p_name AS b FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)"""


def _name_pairs(spark, sf_dir):
    parts = _read(spark, sf_dir, "part")
    return parts.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("a")).join(parts.select((F.col("p_partkey") - 1).alias("id"), F.col("p_name").alias("b")), "id")


@query(f"WITH {_NAMES} SELECT id, levenshtein(a, b)::INTEGER AS lev, a = b AS exact FROM n")
def levenshtein(spark, sf_dir):
    """X6, X7."""
    return _name_pairs(spark, sf_dir).select("id", F.levenshtein("a", "b").alias("lev"), (F.col("a") == F.col("b")).alias("exact"))


@query(f"WITH {_NAMES} SELECT id, round(jaro_winkler_similarity(a, b), 6) AS jw FROM n")
def jaro_winkler(spark, sf_dir):
    """X5."""
    return _name_pairs(spark, sf_dir).select("id", _r(sim.jaro_winkler_of("a", "b"), "jw"))


@query(f"""WITH {_NAMES}, t AS (SELECT id, string_split(a, ' ') AS a, string_split(b, ' ') AS b FROM n)
SELECT id, len(a)::INTEGER AS tok1, len(b)::INTEGER AS tok2, len(list_intersect(list_distinct(a), list_distinct(b)))::INTEGER AS common, (a[1] = b[1])::INTEGER AS first_eq FROM t""")
def token_overlap(spark, sf_dir):
    """X10."""
    return _name_pairs(spark, sf_dir).select("id", sim.overlap(F.split("a", " "), F.split("b", " ")).alias("o")).select("id", "o.*")


@query(f"""WITH {_NAMES}, t AS (SELECT id, list_distinct(string_split(a, ' ')) AS a, list_distinct(string_split(b, ' ')) AS b FROM n),
h AS (SELECT id, a, b, list_filter(a, lambda t: len(list_filter(b, lambda u: t = u OR (length(t) >= 3 AND levenshtein(t, u) <= 1))) = 0) AS m1,
  list_filter(b, lambda t: len(list_filter(a, lambda u: t = u OR (length(t) >= 3 AND levenshtein(t, u) <= 1))) = 0) AS m2 FROM t)
SELECT id, len(m1)::INTEGER AS miss1, len(m2)::INTEGER AS miss2, len(list_intersect(a, b))::INTEGER AS common FROM h""")
def extra_words(spark, sf_dir):
    """X11."""
    return _name_pairs(spark, sf_dir).select("id", sim.extra_words(F.split("a", " "), F.split("b", " ")).alias("o")).select("id", "o.*")


def _ratios_sql(source: str, out: str) -> str:
    """CTEs up to ``out`` (k, f, ratio, pratio, tsort, tset) from ``source`` (k, f, a, b), by a subsequence of rows of bits."""
    return f"""{out}_t AS (SELECT k, f, a, b, {_TOK.format('a')} AS p, {_TOK.format('b')} AS q FROM {source}),
{out}_u AS (SELECT k, f, a, b, array_to_string(list_sort(p), ' ') AS sa, array_to_string(list_sort(q), ' ') AS sb, list_sort(list_distinct(p)) AS x, list_sort(list_distinct(q)) AS y FROM {out}_t),
{out}_v AS (SELECT *, array_to_string(list_filter(x, lambda w: list_contains(y, w)), ' ') AS both_, array_to_string(list_filter(x, lambda w: NOT list_contains(y, w)), ' ') AS rx, array_to_string(list_filter(y, lambda w: NOT list_contains(x, w)), ' ') AS ry FROM {out}_u),
{out}_w AS (SELECT *, trim(both_ || ' ' || rx) AS l, trim(both_ || ' ' || ry) AS r, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS s, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS g FROM {out}_v),
{out}_pc AS (SELECT k, f, s AS p, unnest(list_concat(list_transform(range(0, length(g) - length(s) + 1), lambda i: substr(g, i + 1, length(s))), list_concat(
  list_transform(range(1, length(s)), lambda i: substr(g, 1, i)), list_transform(range(1, length(s)), lambda i: substr(g, length(g) - i + 1, i))))) AS q FROM {out}_w WHERE s <> ''),
{out}_nd AS (SELECT a AS p, b AS q FROM {out}_w UNION SELECT sa, sb FROM {out}_w UNION SELECT l, r FROM {out}_w UNION SELECT both_, l FROM {out}_w UNION SELECT both_, r FROM {out}_w UNION SELECT p, q FROM {out}_pc),
{out}_m AS (SELECT p, q, ((1::HUGEINT << length(p)::INTEGER) - 1) AS full_, list_transform(string_split(q, ''), lambda c: list_sum(list_transform(range(0, length(p)), lambda i: CASE WHEN substr(p, i + 1, 1) = c THEN (1::HUGEINT << i::INTEGER) ELSE 0::HUGEINT END))::HUGEINT) AS m
  FROM {out}_nd WHERE p <> '' AND q <> ''),
{out}_l AS (SELECT p, q, 200.0 * (length(p) - bit_count(list_reduce(list_concat([full_], m), lambda z, h: ((z + (z & h)) | (z - (z & h))) & full_))) / (length(p) + length(q)) AS v FROM {out}_m
  UNION ALL SELECT p, q, CASE WHEN p = '' AND q = '' THEN 100.0 ELSE 0.0 END FROM {out}_nd WHERE p = '' OR q = ''),
{out}_pm AS (SELECT k, f, max(v) AS v FROM {out}_pc JOIN {out}_l USING (p, q) GROUP BY 1, 2),
{out} AS (SELECT w.k, w.f, z1.v::DOUBLE AS ratio, (CASE WHEN s = '' THEN CASE WHEN g = '' THEN 100.0 ELSE 0.0 END ELSE pm.v END)::DOUBLE AS pratio, z2.v::DOUBLE AS tsort,
  (CASE WHEN both_ <> '' AND (l = both_ OR r = both_) THEN 100.0 ELSE greatest(z3.v, CASE WHEN both_ = '' THEN 0 ELSE z4.v END, CASE WHEN both_ = '' THEN 0 ELSE z5.v END) END)::DOUBLE AS tset
  FROM {out}_w w JOIN {out}_l z1 ON z1.p = a AND z1.q = b JOIN {out}_l z2 ON z2.p = sa AND z2.q = sb JOIN {out}_l z3 ON z3.p = l AND z3.q = r JOIN {out}_l z4 ON z4.p = both_ AND z4.q = l JOIN {out}_l z5 ON z5.p = both_ AND z5.q = r
  LEFT JOIN {out}_pm pm ON pm.k = w.k AND pm.f = w.f)"""


_LONG_NAME = "p_name || ' ' || lower(p_type) || ' ' || p_size"
_LONG_NAMES = f"nl AS (SELECT p_partkey AS id, {_LONG_NAME} AS a FROM part), nn AS (SELECT x.id, x.a, y.a AS b FROM nl x JOIN nl y ON y.id = x.id + 1)"
_RATIO_ROWS = "rr AS (SELECT id AS k, 'n' AS f, a, b FROM nn UNION ALL SELECT id, 's', replace(a, ' ', ''), replace(b, ' ', '') FROM nn)"


@query(f"""WITH {_LONG_NAMES}, {_RATIO_ROWS}, {_ratios_sql('rr', 'rt')}
SELECT x.k AS id, round(x.ratio, 6) AS ratio, round(x.pratio, 6) AS partial, round(x.tsort, 6) AS token_sort, round(x.tset, 6) AS token_set, round(y.ratio, 6) AS solid
FROM rt x JOIN rt y ON y.k = x.k AND x.f = 'n' AND y.f = 's'""")
def string_ratios(spark, sf_dir):
    """Ratios of names of several words, and without their spaces."""
    names = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr(_LONG_NAME).alias("a"))
    rows = names.join(names.select((F.col("id") - 1).alias("id"), F.col("a").alias("b")), "id")
    got = rows.select("id", sim.text_features(F.col("a"), F.col("b"), "ratio", "pratio", "tsort", "tset").alias("t"), sim.ratio_of(sim.solid(F.col("a")), sim.solid(F.col("b"))).alias("solid"))
    return got.select("id", _r("t.ratio", "ratio"), _r("t.pratio", "partial"), _r("t.tsort", "token_sort"), _r("t.tset", "token_set"), _r("solid", "solid"))


_ADDRESSES = "ad AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_brand || ' ' || p_size % 2 END AS addr_n, p_name AS name_f FROM part)"


@query(f"""WITH {_P}, {_ADDRESSES}, sm AS (SELECT s1, src, tgt, x.name_f AS a, y.name_f AS b FROM pairs JOIN ad x ON x.id = s1 % 200 JOIN ad y ON y.id = tgt WHERE x.addr_n = y.addr_n AND x.addr_n <> ''),
rr AS (SELECT DISTINCT a || '/' || b AS k, 'n' AS f, a, b FROM sm), {_ratios_sql('rr', 'rt')}
SELECT s1, src, tgt, CASE WHEN tset >= 50 THEN 0.5 + 0.5 * p ELSE p END AS p FROM pairs LEFT JOIN sm USING (s1, src, tgt) LEFT JOIN rt ON k = sm.a || '/' || sm.b""")
def same_address_boost(spark, sf_dir):
    """A lift where a pair's records have one address and their names are alike."""
    parts = _read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.expr("CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_brand || ' ' || p_size % 2 END").alias("addr_n"), F.col("p_name").alias("name_f")
    )
    pairs = _pairs(spark, sf_dir)
    first = pairs.select("s1").distinct().join(parts, F.col("s1") % 200 == parts["id"]).select(F.col("s1").alias("id"), "addr_n", "name_f")
    targets = parts.crossJoin(spark.createDataFrame([(2,), (3,)], "src int"))  # both sources have every part
    return decide.same_address_boost(decide.mark_same_address(pairs, first, targets), 0.5, 50.0).select("s1", "src", "tgt", "p")


_FORMS = """f AS (SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'ltd' WHEN 2 THEN 'ltd pvt' ELSE 'inc' END AS a,
  CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'ltd' ELSE 'inc' END AS b FROM supplier)"""


@query(f"""WITH {_FORMS} SELECT id, (a <> '' AND b <> '')::INTEGER AS leg_both, CASE WHEN a <> '' AND b <> '' THEN (a = b)::INTEGER ELSE -1 END AS leg_eq,
  (a <> '' AND b <> '' AND len(list_intersect(string_split(a, ' '), string_split(b, ' '))) = 0)::INTEGER AS leg_conflict FROM f""")
def legal_compare(spark, sf_dir):
    """X12."""
    k = F.col("s_suppkey")
    a = F.when(k % 4 == 0, "").when(k % 4 == 1, "ltd").when(k % 4 == 2, "ltd pvt").otherwise("inc")
    b = F.when(k % 3 == 0, "").when(k % 3 == 1, "ltd").otherwise("inc")
    return _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), sim.legal_compare(a, b).alias("o")).select("id", "o.*")


_FIT = "(t = u OR starts_with(t, u) OR starts_with(u, t) OR ends_with(t, u) OR ends_with(u, t))"


def _unfit_sql(x: str, y: str) -> str:
    return f"len(list_filter({x}, lambda t: len(list_filter({y}, lambda u: {_FIT})) = 0))"


def _undefined(cond: str, value: str) -> str:
    return f"CASE WHEN {cond} THEN ({value})::DOUBLE ELSE -1.0 END"


@query(f"""
WITH n AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, [l_partkey::VARCHAR, '0' || (l_suppkey * 37)::VARCHAR] AS a0, [(l_partkey * 10 + 1)::VARCHAR, (l_suppkey * 37)::VARCHAR] AS b0,
  CASE WHEN l_linenumber % 2 = 0 THEN '0' || (l_suppkey * 37)::VARCHAR ELSE '' END AS z1, (l_suppkey * 37)::VARCHAR AS z2 FROM lineitem),
s AS (SELECT *, list_transform(a0, lambda x: coalesce(nullif(ltrim(x, '0'), ''), '0')) AS a, list_transform(b0, lambda x: coalesce(nullif(ltrim(x, '0'), ''), '0')) AS b, CASE WHEN z1 = '' THEN '' ELSE coalesce(nullif(ltrim(z1, '0'), ''), '0') END AS y1, coalesce(nullif(ltrim(z2, '0'), ''), '0') AS y2 FROM n),
h AS (SELECT *, list_distinct(a) AS sa, list_distinct(b) AS sb, list_filter(a, lambda x: x <> y1) AS ha, list_filter(b, lambda x: x <> y2) AS hb FROM s),
i AS (SELECT *, len(list_intersect(sa, sb)) AS x, len(list_distinct(list_concat(sa, sb))) AS w, len(ha) > 0 AND len(hb) > 0 AS o, ha[1] AS h1, hb[1] AS h2,
  list_filter(ha, lambda x: length(x) >= 3) AS big FROM h)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(x / w, 6) AS num_jac, x::DOUBLE AS num_inter, len(sa)::DOUBLE AS num_n1, len(sb)::DOUBLE AS num_n2,
 {_undefined('o', 'h1 = h2')} AS hno_eq, {_undefined('o', 'starts_with(h1, h2) OR starts_with(h2, h1)')} AS hno_prefix,
 {_undefined('o', 'ends_with(h1, h2) OR ends_with(h2, h1)')} AS hno_suffix, {_undefined('o', 'list_contains(sb, h1) OR list_contains(sa, h2)')} AS hno_in,
 {_undefined('o', 'levenshtein(h1, h2)')} AS hno_lev, {_undefined('o', 'len(list_intersect(list_distinct(ha), list_distinct(hb))) > 0')} AS hno_any,
 {_undefined('o', 'len(ha) > ' + _unfit_sql('ha', 'hb'))} AS hno_anyfix, {_undefined('o AND len(big) > 0', _unfit_sql('big', 'hb'))} AS hno_big_miss,
 {_undefined('len(sb) > 0', _unfit_sql('sa', 'sb'))} AS num_miss1, {_undefined('len(sa) > 0', _unfit_sql('sb', 'sa'))} AS num_miss2,
 {_undefined("z1 <> '' AND z2 <> ''", 'z1 = z2')} AS zip_eq, {_undefined("z1 <> '' AND z2 <> ''", 'substr(z1, 1, 3) = substr(z2, 1, 3)')} AS zip_p3 FROM i""")
def number_features(spark, sf_dir):
    """Sixteen number features."""
    s = lambda c: c.cast("string")
    part, code = F.col("l_partkey"), F.col("l_suppkey") * 37
    zero = F.concat(F.lit("0"), s(code))
    z1 = F.when(F.col("l_linenumber") % 2 == 0, zero).otherwise("")
    features = sim.number_features(F.array(s(part), zero), F.array(s(part * 10 + 1), s(code)), z1, s(code))
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", features.alias("f")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "f.*").withColumn("num_jac", _r("num_jac"))


@query(f"""WITH {_NAMES}, t AS (SELECT id, list_distinct(string_split(a, ' ')) AS a, list_distinct(string_split(b, ' ')) AS b FROM n),
f AS (SELECT token, count(*) / (SELECT count(*) FROM part) AS share FROM (SELECT unnest(list_distinct(string_split(p_name, ' '))) AS token FROM part) GROUP BY 1),
m AS (SELECT id, 'm' AS side, unnest(list_filter(a, lambda x: NOT list_contains(b, x))) AS token FROM t UNION ALL SELECT id, 'e', unnest(list_filter(b, lambda x: NOT list_contains(a, x))) FROM t),
g AS (SELECT id, count(CASE WHEN side = 'm' THEN 1 END) AS mn, max(CASE WHEN side = 'm' THEN share END) AS mx, min(CASE WHEN side = 'm' THEN share END) AS mi,
  count(CASE WHEN side = 'e' THEN 1 END) AS en, max(CASE WHEN side = 'e' THEN share END) AS ex, min(CASE WHEN side = 'e' THEN share END) AS ei FROM m JOIN f USING (token) GROUP BY id)
SELECT id, coalesce(mn, 0) AS miss_n, round(coalesce(mx, -1), 6) AS miss_max, round(coalesce(mi, -1), 6) AS miss_min, coalesce(en, 0) AS extra_n, round(coalesce(ex, -1), 6) AS extra_max, round(coalesce(ei, -1), 6) AS extra_min
FROM t LEFT JOIN g USING (id)""")
def word_differences(spark, sf_dir):
    """Shares of words that a side lacks."""
    parts = _read(spark, sf_dir, "part").select(F.lit(0).alias("grp"), F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("tokens"))
    shares = sparse.document_frequency(parts).select("token", "share")
    pairs = _name_pairs(spark, sf_dir).select("id", F.split("a", " ").alias("a"), F.split("b", " ").alias("b"))
    out = adapt.word_differences(pairs, shares)
    return out.withColumns({c: _r(c) for c in ("miss_max", "miss_min", "extra_max", "extra_min")})


# ---- learning and the whole --------------------------------------------------------------------------------------------


@query()
def cross_validated_scores(spark, sf_dir):
    """M2-M6: boosted trees and a forest over folds, predictions by unseen folds, their blend."""
    labels = _read(spark, sf_dir, "labels")
    docs = _read(spark, sf_dir, "documents").join(labels, "doc_id")
    n = F.size(tx.tokens(F.col("text")))
    symbols = F.length("text") - F.length(F.translate("text", "#*$%&|<>!", ""))
    rows = docs.select("doc_id", F.col("quality").alias("y"), learn.fold_of(F.col("doc_id"), 2).alias("fold"), n.cast("double").alias("words"), (symbols / (n + 1)).alias("symbols"), (F.length("text") / (n + 1)).alias("chars"))
    names = ["words", "symbols", "chars"]
    for learner in ("gbt", "forest"):
        rows = learn.predict(rows, names, learn.fit_folds(rows, names, 2, learner), f"p_{learner}")
    return rows.withColumn("p", learn.blend("p_gbt", "p_forest")).select("doc_id", "y", "fold", _r("p_gbt", "p_gbt"), _r("p_forest", "p_forest"), _r("p", "p"))


@query(f"""WITH {_SCORED}, x AS (SELECT q, d, score FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY round(score, 9) DESC, q) AS n FROM r WHERE rank < 25) WHERE n = 1 AND score >= 0.5)
SELECT s.id AS s1, coalesce(string_agg(d::VARCHAR, ',' ORDER BY round(score, 9) DESC, d), '') AS ids FROM d s LEFT JOIN x ON x.q = s.id WHERE s.source = 'src0' GROUP BY s.id""")
def link_documents(spark, sf_dir):
    """K1: block, score, assign exclusively, decide and list: copies of the first source's documents elsewhere."""
    top = sparse.top_k(sparse.similarity(*_weights(spark, sf_dir)), 25)
    pairs = top.select(F.col("q").alias("s1"), F.lit(2).alias("src"), F.col("d").alias("tgt"), F.round("score", 9).alias("p"))
    chosen = decide.threshold(decide.exclusive(pairs), 0.5)
    lists = adapt.id_lists(chosen.withColumn("id", F.col("tgt")), "id", "p").select("s1", "ids")
    first = _read(spark, sf_dir, "documents").filter("source = 'src0'").select(F.col("doc_id").alias("s1"))
    return first.join(lists, "s1", "left").fillna("", ["ids"])


#: Files of a small linkage task made of parts: noisy copies in two target sources, and what belongs together.
_ENTITIES = {
    1: ("true", "p_name || ' ' || p_type || ' Private Limited'", "p_partkey || ' ' || p_brand || ' Street, Sector ' || p_size || ', 1' || lpad(cast(p_partkey as string), 5, '0')"),
    2: ("p_partkey % 4 <> 0", "upper(p_name) || ' ' || p_type || ' Pvt Ltd'", "p_partkey || ' ' || p_brand || ' St, Sec ' || p_size || ', 1' || lpad(cast(p_partkey as string), 5, '0')"),
    3: ("p_partkey % 3 = 0", "p_name || ' d/b/a ' || p_name || ' ' || p_type || ' & Co'", "'No ' || p_partkey || ', ' || p_brand || ' Street'"),
}


def _entity_files(spark, sf_dir, paths):
    parts = _read(spark, sf_dir, "part").repartition(4, "p_partkey")
    for half, split in enumerate(("train", "test")):
        mine = parts.filter(F.col("p_partkey") % 2 == half)
        for k, (which, name, address) in _ENTITIES.items():
            ids = F.concat(F.lit(f"S{k}-"), F.col("p_partkey").cast("string"))
            country = F.expr("CASE p_partkey % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'India' ELSE 'France' END")
            src.write_tsv(mine.filter(which).select(ids.alias("entity_id"), F.expr(name).alias("business_name"), F.expr(address).alias("business_address"), country.alias("country")), paths.source(split, k))
    links = F.array_compact(F.array(*[F.when(F.expr(_ENTITIES[k][0]), F.concat(F.lit(f"S{k}-"), F.col("p_partkey").cast("string"))) for k in (2, 3)]))
    truth = parts.filter("p_partkey % 2 = 0").select(F.concat(F.lit("S1-"), F.col("p_partkey").cast("string")).alias("source1_entity_id"), F.array_join(links, ",").alias("matched_entity_ids"))
    src.write_tsv(truth, paths.truth())


@query("""WITH r(rule) AS (VALUES ('malformed row'), ('encoding error'), ('duplicate s1'), ('duplicate id'), ('self match'), ('wrong prefix'), ('missing s1'), ('unexpected s1'), ('unknown id')),
f(file) AS (VALUES ('matching_results.tsv'), ('candidate_pairs.tsv'))
SELECT file, rule, 0::BIGINT AS n FROM r, f UNION ALL SELECT 'matching_results.tsv', 'outside candidates', 0
UNION ALL SELECT 'matching_results.tsv', 'entities', count(*) FROM part WHERE p_partkey % 2 = 1
UNION ALL SELECT 'matching_results.tsv', 'macro F0.5 of 0.9 or more', 1""")
def link_files(spark, sf_dir):
    """K1, M1-M8, K2, V3: a whole run from files to files, learnt on half of the entities, on the other half; its report."""
    root = fresh_path(spark, "linkage")
    paths = src.Paths(f"{root}/data", f"{root}/work", f"{root}/out")
    _entity_files(spark, sf_dir, paths)
    settings = linkage.Settings(dense=10, reverse=2, sparse=10, cap_dense=5, cap_sparse=3, folds=2, first="forest", learners=("forest",))
    linkage.train(spark, paths, settings)
    matches = linkage.infer(spark, paths, "test", settings)
    key = F.substring_index(F.col("s1"), "-", -1).cast("long")
    universe = src.read_entities(spark, paths.source("test", 1)).select(F.col("entity_id").alias("s1"))
    truth = universe.withColumn("k", key).select("s1", F.explode(F.array_compact(F.array(*[F.when(F.expr(_ENTITIES[n][0].replace("p_partkey", "k")), F.lit(n)) for n in (2, 3)]))).alias("src"), "k")
    truth = truth.select("s1", "src", F.concat(F.lit("S"), F.col("src").cast("string"), F.lit("-"), F.col("k").cast("string")).alias("tgt"))
    good = evaluate.macro(evaluate.per_entity(universe, matches, truth)).select(F.lit("macro F0.5 of 0.9 or more").alias("rule"), (F.col("macro_f") >= 0.9).cast("long").alias("n"))
    size = src.read_truth(spark, f"{paths.out}/matching_results.tsv").agg(F.count("*").alias("n")).select(F.lit("entities").alias("rule"), "n")
    more = size.unionByName(good).select(F.lit("matching_results.tsv").alias("file"), "rule", "n")
    return linkage.check(spark, paths).select("file", "rule", "n").unionByName(more)


# ---- records, pair features and second stage ---------------------------------------------------------------------------


@query(f"SELECT p_partkey AS id, {_base_sql('p_name')} || ' | ' || {_base_sql('p_type')} AS enc FROM part")
def encoder_text(spark, sf_dir):
    """what an encoder reads."""
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), records.encoder_text(F.col("p_name"), F.col("p_type")).alias("enc"))


@query(_filler_sql(f""", g AS (SELECT grp, list(token) AS fill FROM m WHERE f2 >= 0.001 AND f2 >= 1.8 * f1 GROUP BY grp),
x AS (SELECT doc_id, {_DOC_TOK} AS c, fill FROM documents LEFT JOIN g ON grp = lang),
y AS (SELECT doc_id, c, CASE WHEN fill IS NULL THEN c ELSE list_filter(c, lambda t: NOT list_contains(fill, t)) END AS k FROM x)
SELECT doc_id, md5(array_to_string(CASE WHEN len(k) = 0 THEN c ELSE k END, ' ')) AS name_f, len(CASE WHEN len(k) = 0 THEN c ELSE k END)::INTEGER AS n FROM y"""))
def apply_fillers(spark, sf_dir):
    """words without their group's fillers, as a digest of the whole."""
    found = sparse.fillers(*_sides(spark, sf_dir))
    rows = _read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("grp"), tx.base(F.col("text")).alias("name_c"), F.lit("").alias("legal"), F.lit("").alias("addr_n"))
    out = records.apply_fillers(rows, found)
    return out.select("doc_id", F.md5(F.col("name_f").cast("binary")).alias("name_f"), F.size(tx.tokens(F.col("name_f"))).alias("n"))


@query("SELECT DISTINCT c_nationkey AS grp FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)")
def unseen_groups(spark, sf_dir):
    """F32, U4: groups that the other side (suppliers in debt) lacks."""
    debtors = _read(spark, sf_dir, "supplier").filter("s_acctbal < 0")
    return records.unseen(_read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("grp")), debtors.select(F.col("s_nationkey").alias("grp")))


_RECORDS = f"""{_RAW}, {_names_sql('rn')}, {_addresses_sql('ra')},
fr0 AS (SELECT p_partkey AS id, p_name, CASE WHEN p_partkey % 11 IN (1, 4, 7) THEN 'France' ELSE 'x' || p_partkey % 3 END AS grp, 2 + p_partkey % 2 AS src FROM part),
fd AS (SELECT n.id, grp, src, list_filter(string_split(name_c, ' '), lambda x: x <> '') AS c FROM names n JOIN fr0 USING (id)),
fs AS (SELECT grp, token, count(CASE WHEN src = 3 THEN 1 END) / any_value(n1) AS f1, count(CASE WHEN src = 2 THEN 1 END) / any_value(n2) AS f2
  FROM (SELECT grp, src, unnest(list_distinct(list_filter(c, lambda x: NOT regexp_full_match(x, '[0-9]+')))) AS token FROM fd) JOIN (SELECT grp, count(CASE WHEN src = 3 THEN 1 END) AS n1, count(CASE WHEN src = 2 THEN 1 END) AS n2 FROM fd GROUP BY grp) USING (grp) GROUP BY 1, 2),
fl AS (SELECT grp, list(token) AS fill FROM fs WHERE f2 >= 0.001 AND f2 >= 1.8 * CASE WHEN f1 > 0 THEN f1 ELSE 1e-6 END GROUP BY grp),
ff0 AS (SELECT id, grp, src, c, list_filter(c, lambda x: fill IS NULL OR NOT list_contains(fill, x)) AS k FROM fd LEFT JOIN fl USING (grp)),
ff AS (SELECT id, grp, src, c, CASE WHEN len(k) = 0 THEN c ELSE k END AS ft FROM ff0),
rec AS (SELECT n.id, n.raw AS name, name_n, name_c, c, array_to_string(list_transform(c, lambda x: {_skeleton_sql('x')}), ' ') AS name_k, array_to_string(ft, ' ') AS name_f, list_transform(ft, lambda x: {_skeleton_sql('x')}) AS fk,
  name_alt, legal, is_dom, CASE WHEN grp = 'France' THEN addr_fr ELSE addr_n END AS addr_n, numbers, zip FROM names n JOIN addrs a ON a.id = n.id JOIN ff ON ff.id = n.id)"""


def _part_records(spark, sf_dir):
    raw = _raw(spark, sf_dir).select(
        "id", F.expr("CASE WHEN id % 11 IN (1, 4, 7) THEN 'France' ELSE 'x' || id % 3 END").alias("grp"), "name", "address", (2 + F.col("id") % 2).cast("int").alias("src")
    )
    rows = records.normalize(raw)
    texts = rows.select("grp", "id", "src", tx.tokens(F.col("name_c")).alias("tokens"))
    return records.apply_fillers(rows, sparse.fillers(texts.filter("src = 3"), texts.filter("src = 2")))


_TEXT_FIELDS = {
    "n": "x.name_c, y.name_c", "nf": "x.name_n, y.name_n", "nk": "x.name_k, y.name_k", "nns": "replace(x.name_c, ' ', ''), replace(y.name_c, ' ', '')",
    "raw": "lower(coalesce(x.name, '')), lower(coalesce(y.name, ''))", "nx": "x.name_f, y.name_f", "nxk": "array_to_string(x.fk, ' '), array_to_string(y.fk, ' ')", "a": "x.addr_n, y.addr_n",
    "m1": "CASE WHEN x.name_alt <> '' THEN x.name_alt ELSE x.name_c END, y.name_c", "m2": "x.name_c, CASE WHEN y.name_alt <> '' THEN y.name_alt ELSE y.name_c END",
}
_TEXT_ROWS = "fp (k, f, a, b) AS (" + " UNION ALL ".join(f"SELECT x.id, '{f}', {ab} FROM rec x JOIN rec y ON y.id = x.id + 1" for f, ab in _TEXT_FIELDS.items()) + ")"


def _picked_sql(**kinds: str) -> str:
    return ", ".join(f"round(max(CASE WHEN f = '{f}' THEN {kind} END), 6) AS {f}_{kind}" for f, some in kinds.items() for kind in some.split())


_MISSING = "len(list_filter({0}, lambda t: len(list_filter({1}, lambda u: t = u OR (length(t) >= 3 AND levenshtein(t, u) <= 1))) = 0))::DOUBLE"


@query(f"""WITH {_RECORDS}, {_TEXT_ROWS}, {_ratios_sql('fp', 'rt')},
tf AS (SELECT k, {_picked_sql(n='ratio pratio tsort tset', nf='ratio tset', nk='ratio tset', nns='ratio pratio', raw='ratio', nx='ratio tset tsort', nxk='ratio', a='ratio tsort tset pratio', m1='tset', m2='tset')} FROM rt GROUP BY k),
nm AS (SELECT x.id AS s1, y.id AS tgt, x.name_c AS c1, y.name_c AS c2, x.name_k AS k1, y.name_k AS k2, x.name_f AS f1, y.name_f AS f2, x.fk AS w1, y.fk AS w2, x.name_alt AS t1, y.name_alt AS t2, x.legal AS l1, y.legal AS l2, x.is_dom AS d1, y.is_dom AS d2,
  x.addr_n AS e1, y.addr_n AS e2, list_distinct(x.c) AS u1, list_distinct(y.c) AS u2, x.c[1] AS q1, y.c[1] AS q2, x.numbers AS n1, y.numbers AS n2, x.zip AS z1, y.zip AS z2 FROM rec x JOIN rec y ON y.id = x.id + 1),
sn AS (SELECT *, list_transform(n1, lambda x: {_STRIP_SQL}) AS a, list_transform(n2, lambda x: {_STRIP_SQL}) AS b, CASE WHEN z1 = '' THEN '' ELSE list_transform([z1], lambda x: {_STRIP_SQL})[1] END AS y1, CASE WHEN z2 = '' THEN '' ELSE list_transform([z2], lambda x: {_STRIP_SQL})[1] END AS y2 FROM nm),
hn AS (SELECT *, list_distinct(a) AS sa, list_distinct(b) AS sb, list_filter(a, lambda x: x <> y1) AS ha, list_filter(b, lambda x: x <> y2) AS hb FROM sn),
i AS (SELECT *, len(list_intersect(sa, sb)) AS x, len(list_distinct(list_concat(sa, sb))) AS w, len(ha) > 0 AND len(hb) > 0 AS o, ha[1] AS h1, hb[1] AS h2, list_filter(ha, lambda x: length(x) >= 3) AS big FROM hn)
SELECT s1, (2 + tgt % 2)::INTEGER AS src, tgt, tf.* EXCLUDE (k, m1_tset, m2_tset), round(CASE WHEN c1 = c2 THEN 1 ELSE jaro_winkler_similarity(c1, c2) END, 6) AS n_jw, (c1 = c2)::INTEGER::DOUBLE AS n_exact, levenshtein(c1, c2)::DOUBLE AS n_lev, (k1 = k2)::INTEGER::DOUBLE AS nk_exact,
 (t1 <> '' OR t2 <> '')::INTEGER::DOUBLE AS has_alt, CASE WHEN t1 <> '' OR t2 <> '' THEN greatest(m1_tset, m2_tset) ELSE -1.0 END AS alt_tset,
 len(u1)::DOUBLE AS n_tok1, len(u2)::DOUBLE AS n_tok2, len(list_intersect(u1, u2))::DOUBLE AS n_common, (coalesce(q1, '') = coalesce(q2, ''))::INTEGER::DOUBLE AS n_first_eq, length(c1)::DOUBLE AS n_len1, length(c2)::DOUBLE AS n_len2,
 round(CASE WHEN f1 = f2 THEN 1 ELSE jaro_winkler_similarity(f1, f2) END, 6) AS nx_jw, (f1 = f2)::INTEGER::DOUBLE AS nx_exact, (array_to_string(w1, ' ') = array_to_string(w2, ' '))::INTEGER::DOUBLE AS nxk_exact, d1::INTEGER::DOUBLE AS dom1, d2::INTEGER::DOUBLE AS dom2, (e2 = '')::INTEGER::DOUBLE AS a_empty2,
 round(CASE WHEN e1 = e2 THEN 1 ELSE jaro_winkler_similarity(e1, e2) END, 6) AS a_jw, length(e1)::DOUBLE AS a_len1, length(e2)::DOUBLE AS a_len2,
 (l1 <> '' AND l2 <> '')::INTEGER::DOUBLE AS leg_both, CASE WHEN l1 <> '' AND l2 <> '' THEN (l1 = l2)::INTEGER ELSE -1 END::DOUBLE AS leg_eq, (l1 <> '' AND l2 <> '' AND len(list_intersect(string_split(l1, ' '), string_split(l2, ' '))) = 0)::INTEGER::DOUBLE AS leg_conflict,
 {_MISSING.format('list_distinct(w1)', 'w2')} AS nx_miss1, {_MISSING.format('list_distinct(w2)', 'w1')} AS nx_miss2, len(list_intersect(list_distinct(w1), list_distinct(w2)))::DOUBLE AS nx_common,
 round(CASE WHEN w > 0 THEN x / w ELSE -1.0 END, 6) AS num_jac, x::DOUBLE AS num_inter, len(sa)::DOUBLE AS num_n1, len(sb)::DOUBLE AS num_n2,
 {_undefined('o', 'h1 = h2')} AS hno_eq, {_undefined('o', 'starts_with(h1, h2) OR starts_with(h2, h1)')} AS hno_prefix,
 {_undefined('o', 'ends_with(h1, h2) OR ends_with(h2, h1)')} AS hno_suffix, {_undefined('o', 'list_contains(sb, h1) OR list_contains(sa, h2)')} AS hno_in,
 {_undefined('o', 'levenshtein(h1, h2)')} AS hno_lev, {_undefined('o', 'len(list_intersect(list_distinct(ha), list_distinct(hb))) > 0')} AS hno_any,
 {_undefined('o', 'len(ha) > ' + _unfit_sql('ha', 'hb'))} AS hno_anyfix, {_undefined('o AND len(big) > 0', _unfit_sql('big', 'hb'))} AS hno_big_miss,
 {_undefined('len(sb) > 0', _unfit_sql('sa', 'sb'))} AS num_miss1, {_undefined('len(sa) > 0', _unfit_sql('sb', 'sa'))} AS num_miss2,
 {_undefined("z1 <> '' AND z2 <> ''", 'z1 = z2')} AS zip_eq, {_undefined("z1 <> '' AND z2 <> ''", 'substr(z1, 1, 3) = substr(z2, 1, 3)')} AS zip_p3 FROM i JOIN tf ON k = s1""")
def pair_features(spark, sf_dir):
    """X1-X14, appendix B: all 62 string and number features of neighbouring parts, with fillers found in their names."""
    rows = _part_records(spark, sf_dir)
    pairs = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("s1"), (2 + (F.col("p_partkey") + 1) % 2).cast("int").alias("src"), (F.col("p_partkey") + 1).alias("tgt"))
    out = features.pair_features(pairs, rows, rows)
    return out.select("s1", "src", "tgt", *[_r(F.col(c).cast("double"), c) for c in out.columns if c not in ("s1", "src", "tgt")])


def _cos_sql(name: str, tokens: str, least: int) -> str:
    return f"""{name}_t AS (SELECT p_brand AS grp, p_partkey AS id, {tokens} AS tokens FROM part),
{name}_n AS (SELECT grp, count(*) AS n FROM {name}_t GROUP BY 1),
{name}_f AS (SELECT grp, token, count(*) AS df FROM (SELECT grp, unnest(list_distinct(tokens)) AS token FROM {name}_t) GROUP BY 1, 2 HAVING count(*) >= {least}),
{name}_w0 AS (SELECT grp, id, token, (1 + ln(count(*))) * any_value(ln((1 + n) / (1 + df)) + 1) AS w FROM (SELECT grp, id, unnest(tokens) AS token FROM {name}_t) JOIN {name}_f USING (grp, token) JOIN {name}_n USING (grp) GROUP BY 1, 2, 3),
{name}_w AS (SELECT grp, id, token, w / sqrt(sum(w * w) OVER (PARTITION BY grp, id)) AS w FROM {name}_w0),
{name}_s AS (SELECT a.id AS q, b.id AS d, sum(a.w * b.w) AS s FROM {name}_w a JOIN {name}_w b ON a.grp = b.grp AND a.token = b.token WHERE a.id % 2 = 1 AND b.id % 2 = 0 GROUP BY 1, 2)"""


_ADDR_SQL = "lower(p_type) || ' ' || p_size"
_NAME_F_SQL = "string_split(p_name, ' ')[2]"
_COSINES = {
    "n_idf": _cos_sql("n_idf", "string_split(p_name, ' ')", 1), "n_c3": _cos_sql("n_c3", _GRAMS_SQL, 1), "nx_idf": _cos_sql("nx_idf", f"[{_NAME_F_SQL}]", 1),
    "a_idf": _cos_sql("a_idf", f"string_split({_ADDR_SQL}, ' ')", 1), "a_c3": _cos_sql("a_c3", _GRAMS_SQL.replace("p_name", f"({_ADDR_SQL})"), 2),
}


@query(f"""WITH {', '.join(_COSINES.values())},
p AS (SELECT a.p_brand AS grp, a.p_partkey AS q, b.p_partkey AS d FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size WHERE a.p_partkey % 2 = 1 AND b.p_partkey % 2 = 0)
SELECT p.*, {', '.join(f'round(coalesce(x{k}.s, 0), 6) AS {name}' for k, name in enumerate(_COSINES))}
FROM p {' '.join(f'LEFT JOIN {name}_s x{k} USING (q, d)' for k, name in enumerate(_COSINES))}""")
def feature_cosines(spark, sf_dir):
    """The five cosines, fitted on both sides together, of words and of 3-grams, in one pass."""
    parts = _read(spark, sf_dir, "part").select(
        F.col("p_brand").alias("grp"), F.col("p_partkey").alias("id"), "p_size", F.col("p_name").alias("name_c"), F.get(F.split("p_name", " "), F.lit(1)).alias("name_f"),
        F.concat_ws(" ", F.lower("p_type"), F.col("p_size").cast("string")).alias("addr_n"),
    )
    one, two = parts.filter("id % 2 = 1"), parts.filter("id % 2 = 0")
    return features.matched_cosines(one, two, ["grp", "p_size"]).select("grp", "q", "d", *[_r(c, c) for c in features.COSINES])


_HARD = f"""{_P}, h AS (SELECT *, ((s1 + tgt) % 3 = 0)::INTEGER AS y, row_number() OVER (PARTITION BY s1, src ORDER BY p DESC, tgt) - 1 AS dense_r2,
  CASE WHEN tgt % 2 = 0 THEN row_number() OVER (PARTITION BY s1, src ORDER BY p, tgt) - 1 END AS sparse_r2 FROM pairs)"""


@query(f"WITH {_HARD} SELECT s1, src, tgt, y FROM h WHERE y = 1 OR dense_r2 < 1 OR sparse_r2 < 1")
def hard_pairs(spark, sf_dir):
    """Training pairs of a pair scorer."""
    rank = lambda *order: F.row_number().over(Window.partitionBy("s1", "src").orderBy(*order)) - 1
    rows = _pairs(spark, sf_dir).withColumns({"y": ((F.col("s1") + F.col("tgt")) % 3 == 0).cast("int"), "dense_r2": rank(F.desc("p"), "tgt"), "sparse_r2": F.when(F.col("tgt") % 2 == 0, rank("p", "tgt"))})
    return features.hard_pairs(rows, 1, 1).select("s1", "src", "tgt", "y")


@query(f"""WITH {_P}, c AS (SELECT *, CASE WHEN tgt % 3 = 0 THEN ((s1 * 31 + tgt * 17) % 1000) / 1000 ELSE -1.0 END AS ce FROM pairs)
SELECT s1, src, tgt, p, ce::DOUBLE AS ce, max(ce) OVER (PARTITION BY s1, src)::DOUBLE AS cectx_s1max, row_number() OVER (PARTITION BY src, tgt ORDER BY ce DESC, s1) AS cectx_trank,
  max(p) OVER (PARTITION BY src, tgt) AS pc_tmax, count(*) OVER (PARTITION BY s1, src) AS pc_s1n, round(sum(p) OVER (PARTITION BY s1), 6) AS s1sum_all FROM c""")
def second_stage(spark, sf_dir):
    """M8, M9: scores, a further score where there is one, and the context of both."""
    pairs = _pairs(spark, sf_dir)
    ce = pairs.filter("tgt % 3 = 0").select("s1", "src", "tgt", (((F.col("s1") * 31 + F.col("tgt") * 17) % 1000) / 1000).alias("ce"))
    out = features.second_stage(pairs, {"ce": ce})
    return out.select("s1", "src", "tgt", "p", "ce", "cectx_s1max", "cectx_trank", "pc_tmax", "pc_s1n", _r("s1sum_all", "s1sum_all"))


@query(f"""WITH {_NAMES}, t AS (SELECT id, a, b, list_distinct(string_split(a, ' ')) AS x, list_distinct(string_split(b, ' ')) AS y FROM n),
g AS (SELECT id, a, b, list_filter(x, lambda w: NOT list_contains(y, w)) AS m, list_filter(y, lambda w: NOT list_contains(x, w)) AS e FROM t)
SELECT id, CASE WHEN len(m) = 1 AND len(e) = 1 THEN round(jaro_winkler_similarity(m[1], e[1]), 6) ELSE -1.0 END AS swap_jw, (a = b)::INTEGER::DOUBLE AS same_addr FROM g""")
def word_swaps(spark, sf_dir):
    """The similarity of a single replaced word, and equal addresses."""
    pairs = _name_pairs(spark, sf_dir).withColumns({"addr1": F.col("a"), "addr2": F.col("b")})
    return features.swaps(pairs).select("id", _r("swap_jw", "swap_jw"), "same_addr")


@query(f"""WITH {_VEC_SQL} SELECT a.id AS q, b.id AS d, round(sum(CASE WHEN a.k = b.k THEN a.c * b.c ELSE 0 END) / any_value(x.l * y.l), 6) AS score
FROM v a JOIN v b ON b.id = a.id + 1 JOIN l x ON x.id = a.id JOIN l y ON y.id = b.id GROUP BY 1, 2""")
def hashed_vectors(spark, sf_dir):
    """An untrained encoder, by the inner products of neighbours."""
    # names are dealt by id first: a small file is few tasks, and the vectors' own join needs no other order
    names = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name").repartition("id")
    v = dense.hashed_vectors(names.select("id", tx.char_grams(F.col("p_name")).alias("tokens")))
    return dense.pair_dot(v.select(F.col("id").alias("q"), (F.col("id") + 1).alias("d")), v, v).withColumn("score", _r("score"))


# ---- decisions by configuration, sampling, files -----------------------------------------------------------------------


def _grid_sql(x: str, bias: str) -> str:
    return f"""m AS (SELECT excl, p.s1, p.src, p.tgt, p.p FROM pairs p JOIN (SELECT false AS excl UNION ALL SELECT true) ON NOT excl OR (p.s1, p.src, p.tgt) IN (SELECT (s1, src, tgt) FROM ex)),
ef0 AS (SELECT excl, x, s1, src, tgt, p, row_number() OVER w AS k, sum(p) OVER (w ROWS UNBOUNDED PRECEDING) AS cs, sum(p) OVER (PARTITION BY excl, x, s1) AS tot, product(1 - p) OVER (PARTITION BY excl, x, s1) AS none
  FROM m, (VALUES {x}) f(x) WHERE p >= x / 2 WINDOW w AS (PARTITION BY excl, x, s1 ORDER BY p DESC, src, tgt)),
ef1 AS (SELECT *, round(1.25 * cs / (k + 0.25 * tot), 12) AS ef FROM ef0),
ef2 AS (SELECT *, max(ef) OVER (PARTITION BY excl, x, s1) AS best FROM ef1),
ef3 AS (SELECT *, min(CASE WHEN ef = best THEN k END) OVER (PARTITION BY excl, x, s1) AS kb FROM ef2),
ch AS (SELECT excl, 'ef' AS rule, x, bias, s1, src, tgt FROM ef3, (VALUES {bias}) b(bias) WHERE k <= kb AND p >= x AND best > none * bias)"""


@query(f"""WITH {_EXCL}, {_grid_sql('(0.3), (0.4), (0.5), (0.6)', '(1.0), (1.3), (1.6)')},
al AS (SELECT * FROM ch UNION ALL SELECT excl, 'thr', t, 1.0, s1, src, tgt FROM m, (VALUES (0.4), (0.5), (0.55), (0.6), (0.65), (0.7), (0.75), (0.8), (0.85), (0.9), (0.95)) v(t) WHERE p >= t),
{_TRUTH}, n AS (SELECT s1, count(*) AS n_true FROM truth GROUP BY 1),
c AS (SELECT excl, rule, x, bias, s1, count(*) AS n_pred, count(CASE WHEN (s1 + tgt) % 3 = 0 THEN 1 END) AS tp FROM al GROUP BY ALL),
u AS (SELECT * FROM (SELECT o_orderkey AS s1 FROM orders), (SELECT DISTINCT excl, rule, x, bias FROM c)),
f AS (SELECT excl, rule, x, bias, CASE WHEN coalesce(n_pred, 0) = 0 AND coalesce(n_true, 0) = 0 THEN 1.0 WHEN coalesce(tp, 0) = 0 THEN 0.0
  ELSE 1.25 * tp / (1.25 * tp + 0.25 * (n_true - tp) + n_pred - tp) END::DOUBLE AS f FROM u LEFT JOIN c USING (excl, rule, x, bias, s1) LEFT JOIN n USING (s1))
SELECT excl, rule, x::DOUBLE AS x, bias::DOUBLE AS bias, round(avg(f), 6) AS macro_f FROM f GROUP BY ALL""")
def config_grid(spark, sf_dir):
    """All 46 configurations of rule, exclusivity, threshold, floor and bias, scored in one job."""
    universe = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("s1"))
    # dealt by what comes next, so that pairs are made distinct where they lie
    out = decide.config_scores(_pairs(spark, sf_dir, "src", "tgt"), _truth(_pairs(spark, sf_dir, "s1")), universe)
    return out.withColumn("macro_f", _r("macro_f"))


@query(f"""WITH {_EF}, o AS (SELECT o_orderkey AS s1, o_orderpriority AS country FROM orders)
SELECT s1, src, tgt, country FROM ef JOIN o USING (s1) WHERE country NOT IN ('1-URGENT', '5-LOW')
UNION ALL SELECT s1, src, tgt, country FROM ex JOIN o USING (s1) WHERE country IN ('1-URGENT', '5-LOW') AND p >= 0.9""")
def variant_by_group(spark, sf_dir):
    """Groups decided anew by another rule, others as they were."""
    pairs = _pairs(spark, sf_dir)
    group = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("s1"), F.col("o_orderpriority").alias("country"))
    first, again = (decide.by_config(pairs, c).join(group, "s1") for c in (src.Decision(), src.Decision(rule="thr", t=0.9)))
    return decide.replace_groups(first, again, ["1-URGENT", "5-LOW"]).select("s1", "src", "tgt", "country")


@query("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 500")
def sample_rows(spark, sf_dir):
    """A reproducible sample (its size is the operator's parameter)."""
    return learn.sample(_read(spark, sf_dir, "orders"), "o_orderkey", 500).select("o_orderkey", "o_orderpriority")


@query("""SELECT 'S1-' || c_custkey AS entity_id, CASE WHEN c_custkey % 7 = 0 THEN '"' || c_name ELSE c_name END AS business_name,
  CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_nationkey || ' "High" St' END AS business_address, c_mktsegment AS country, 1 AS src FROM customer""")
def tsv_round_trip(spark, sf_dir):
    """Entities to a tab-separated file and back, quotation marks and empty fields whole."""
    k = F.col("c_custkey")
    rows = _read(spark, sf_dir, "customer").select(
        F.concat(F.lit("S1-"), k.cast("string")).alias("entity_id"), F.when(k % 7 == 0, F.concat(F.lit('"'), "c_name")).otherwise(F.col("c_name")).alias("business_name"),
        F.when(k % 5 == 0, "").otherwise(F.concat(F.col("c_nationkey").cast("string"), F.lit(' "High" St'))).alias("business_address"), F.col("c_mktsegment").alias("country"),
    )
    path = fresh_path(spark, "entities")
    src.write_tsv(rows, path)
    return src.read_entities(spark, path)


@query(f"""WITH {_LISTS}, u AS (SELECT o_orderkey AS s1 FROM orders)
SELECT s1::VARCHAR AS s1, coalesce(array_to_string(list_filter(string_split(ids, ','), lambda z, k: list_position(string_split(ids, ','), z) = k), ','), '') AS ids FROM u LEFT JOIN lists USING (s1)""")
def id_list_file(spark, sf_dir):
    """An id-list file with a row for each entity, empty lists too, read back."""
    universe, path = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("s1")), fresh_path(spark, "id-lists")
    src.write_id_lists(universe, _lists(spark, sf_dir), path)
    return src.read_truth(spark, path)


@query(f"""WITH {_LISTS}, u AS (SELECT o_orderkey AS s1 FROM orders), y AS (SELECT DISTINCT s1, id FROM x)
SELECT 'malformed row' AS rule, 0::BIGINT AS n, NULL::VARCHAR AS sample UNION ALL SELECT 'encoding error', 0, NULL UNION ALL SELECT 'duplicate s1', 0, NULL UNION ALL SELECT 'duplicate id', 0, NULL
UNION ALL SELECT 'self match', count(*), min(s1::VARCHAR) FROM y WHERE id LIKE 'S1-%' UNION ALL SELECT 'wrong prefix', count(*), min(s1::VARCHAR) FROM y WHERE id NOT SIMILAR TO 'S[123]-.*'
UNION ALL SELECT 'missing s1', 0, NULL UNION ALL SELECT 'unexpected s1', 0, NULL""")
def validate_file(spark, sf_dir):
    """V1, V3: the rules on a file as it was written."""
    universe, path = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("s1")), fresh_path(spark, "id-lists")
    src.write_id_lists(universe, _lists(spark, sf_dir), path)
    return validate.validate_file(spark, path, ("source1_entity_id", "matched_entity_ids"), universe)


@query()
def adapted_scores(spark, sf_dir):
    """Models of labelled groups and of pseudo-labels in another, cross-fitted, if they pass the gate; rows by unseen folds."""
    docs = _read(spark, sf_dir, "documents").join(_read(spark, sf_dir, "labels"), "doc_id", "left")
    n = F.size(tx.tokens(F.col("text")))
    rows = docs.select("doc_id", "lang", F.col("quality").alias("y"), learn.fold_of(F.col("doc_id"), 2).alias("fold"), n.cast("double").alias("words"), (F.length("text") / (n + 1)).alias("chars"))
    names = ["words", "chars"]
    labelled = rows.filter("y IS NOT NULL AND lang <> 'fr'")
    before = learn.fit_folds(labelled, names, 2)
    french = learn.predict(rows.filter("lang = 'fr'").drop("y"), names, before, "p").withColumns({"src": F.lit(2), "tgt": F.col("doc_id"), "near": F.lit(False)})
    pseudo = adapt.pseudo_labels(french, 0.9, 0.1).drop("p", "src", "tgt", "near")
    likelihood = lambda df: -df.agg(learn.log_loss(F.col("y"), F.col("p")).alias("x")).first().x
    models = learn.adapt_gated(labelled, pseudo, names, before, likelihood, slack=0.05)
    return learn.predict(rows, names, models).select("doc_id", "lang", "fold", _r("p", "p"))
