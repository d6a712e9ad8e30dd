"""The same queries as SQL over the given tables."""

from __future__ import annotations

from lexiflow.catalog.inputs import LEXICON
from lexiflow.functions import patterns as P

_CTES: dict[str, str] = {}


def _text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("'", "''") + "'"


def _with(names: str, select: str) -> str:
    """The named common table expressions, in order, before a select."""
    parts = [f"{name} as materialized ({_CTES[name]})" for name in names.split()]
    return "with recursive " + ",\n".join(parts) + "\n" + select


def _rules(column: str, rules) -> str:
    for pattern, replacement in rules:
        column = f"regexp_replace({column}, {_text(pattern)}, {_text(replacement)}, 'g')"
    return column


def _all(column: str, pattern: str) -> str:
    return f"regexp_extract_all({column}, {_text(pattern)}, 0)"


def _tokens(column: str) -> str:
    return _all(column, P.TOKEN)


def _runs(column: str) -> str:
    return _all(column, P.WORD_RUN)


def _plain(column: str) -> str:
    return _all(column, "[a-zA-Z][a-z]+")


_ONE_LINE = r"regexp_replace(body, '[\t\r\n]+', ' ', 'g')"
_KEY = "substr(doc_id, 2, 8)"
_ISSN = "regexp_replace(issn, '-', '')"
_HASH = "cast('0x' || substr(md5({}), 1, 8) as bigint) % 100"
_STOP = ", ".join(_text(word) for word in P.SEARCH_STOP_WORDS)

_CTES["corpus"] = """
    select concat('S', lpad(cast(cast(regexp_extract(source, '[0-9]+', 0) as bigint)
                                 + case when doc_id % 11 = 0 then 5000000 else 0 end as varchar), 8, '0'),
                  lpad(cast(doc_id as varchar), 8, '0')) as doc_id,
           case when doc_id % 7 = 0
                then concat(text, ' (n=7) gave 12.5 % and p < 0.05 for 3 mg/l of 2,4-',
                            case doc_id % 3 when 0 then 'dinitrophenol'
                                            when 1 then 'dichlorobenzene'
                                            else 'dimethylfuran' end, ' .')
                else text end as body,
           source, lang
    from documents"""
_CTES["cats"] = """
    with listed as (
        select s_name as journal, n_regionkey, s_suppkey,
               lpad(cast(s_suppkey as varchar), 8, '0') as padded
        from supplier join nation on s_nationkey = n_nationkey),
    placed as (
        select *, n_regionkey as place from listed
        union all
        select *, (n_regionkey + 1) % 5 from listed where s_suppkey % 4 = 0)
    select journal, concat(substr(padded, 1, 4), '-', substr(padded, 5, 4)) as issn,
           r_name as category
    from placed join region on place = r_regionkey"""
_CTES["dictionary"] = f"""
    select distinct lower(w) as term
    from (select unnest({_plain("text")}) as w from benchmark)"""
_CTES["lexicon"] = "select * from (values {}) t(term, type, penn_tag, lemma)".format(
    ", ".join(
        "({})".format(", ".join("null" if v is None else _text(v) for v in row))
        for row in LEXICON
    )
)
_CTES["tags"] = """
    select term, penn_tag, lemma from lexicon
    union all
    select term, case right(term, 1) when 's' then 'NNS' when 'd' then 'VBD' else 'JJ' end,
           case right(term, 1) when 'n' then term else left(term, length(term) - 1) end
    from (select distinct unnest(regexp_extract_all(body, '[a-z]{5,}', 0)) as term from corpus)
    where right(term, 1) in ('s', 'd', 'n') and term not in (select term from lexicon)"""
_CTES["shapes"] = rf"""
    select distinct unnest(regexp_extract_all(body, {_text(P.SEED_SHAPE)}, 0)) as shape
    from corpus"""
_CTES["mined"] = rf"""
    select distinct seed from (
        select unnest(regexp_extract_all(shape, {_text(P.SEED_FRAGMENT)}, 0)) as seed from shapes)
    where length(seed) >= 4"""
_CTES["word_seeds"] = f"""
    select seed from mined
    union all
    select distinct lower(w) from (select unnest({_plain("body")}) as w from corpus)"""
_CTES["name_heads"] = f"""
    select distinct substr(seed, 1, 10) as head from word_seeds
    where seed not in (select term from dictionary)
      and not regexp_matches(seed, {_text(P.NOT_LATIN_GREEK)})"""
_CTES["name_runs"] = f"""
    select distinct doc_id, regexp_extract(substr(shape, p, 10), {_text("^" + P.LETTER + "+")}, 0) as run
    from (select doc_id, shape, unnest(range(2, length(regexp_extract(shape, {_text("^" + P.LOCANT_HEADER)}, 0)) + 2)) as p
          from (select distinct doc_id, unnest({_all("body", P.NAME_SHAPE)}) as shape from corpus))
    where regexp_matches(substr(shape, p, 1), {_text(P.LETTER)})"""
_CTES["name_pattern"] = f"""
    select doc_id, {_text(P.LOCANT_HEADER + "(?:(?:")} || string_agg(distinct head, '|' order by head)
           || {_text(")[a-zA-Z]*)" + P.LOCANT_TRAILER)} as pattern
    from (select doc_id, substr(run, 1, n) as head
          from (select doc_id, run, unnest(range(1, length(run) + 1)) as n from name_runs))
    where head in (select head from name_heads) group by doc_id"""
_NAMES = "corpus shapes mined dictionary word_seeds name_heads name_runs name_pattern"
_CTES["words"] = f"""
    select doc_id, w as term
    from (select doc_id, unnest({_runs("lower(body)")}) as w from corpus)
    where regexp_full_match(w, '[a-z]{{3,}}')"""
_CTES["bag"] = "select doc_id, term, count(*) as n from words group by all"
_CTES["freqs"] = "select term, count(*) as df from bag group by term"
_CTES["weighted"] = """
    select doc_id, term,
           n / sum(n) over (partition by doc_id) * ln(docs.c / df) as weight
    from bag join freqs using (term),
         (select cast(count(*) as double) as c from corpus) docs"""
_CTES["ranked_terms"] = """
    select term, df, row_number() over (order by df desc, term) - 1 as term_id from freqs"""
_WEIGHTS = "corpus words bag freqs weighted"
_CTES["wv"] = f"""
    select term, embedding as vec from ranked_terms join embeddings on term_id = vec_id"""
_CTES["wv_cells"] = """
    select term, unnest(range(len(vec))) as pos, unnest(vec) as x from wv"""
_CTES["pair_counts"] = f"""
    select doc_id, term, count(*) as n
    from (select doc_id, unnest({_tokens("body")}) as term from corpus) group by all"""
_CTES["means"] = """
    select doc_id, pos, sum(n * cast(x as double)) / sum(n) as value
    from pair_counts join wv_cells using (term) group by all"""
_MEANS = "corpus words bag freqs ranked_terms wv wv_cells pair_counts means"
_CTES["cat_index"] = """
    select category, row_number() over (order by category) - 1 as category_id
    from (select distinct category from cats)"""
_CTES["journals"] = f"""
    select {_ISSN} as issn, list_sort(list(category)) as categories from cats group by 1"""
_CTES["single"] = """
    select issn, category_id from journals join cat_index on categories[1] = category
    where len(categories) = 1"""
_CTES["articles"] = f"""
    select doc_id,
           coalesce(regexp_extract(html, '<title>([^<]*)</title>', 1), concat('On ', source))
               as title,
           concat(substr({_KEY}, 1, 4), '-', substr({_KEY}, 5, 4)) as issn,
           source as journal, body as abstract
    from corpus left join pages on page_id = cast(substr(doc_id, 10, 8) as bigint)"""
_CTES["field_texts"] = """
    select doc_id, 'title' as field, title as body from articles
    union all select doc_id, 'journal', journal from articles
    union all select doc_id, 'abstract', abstract from articles"""
_CTES["spans"] = rf"""
    select doc_id, field, token, cast(pos - 1 as integer) as pos,
           sum(gap + length(token)) over (partition by doc_id, field order by pos) as stop
    from (select doc_id, field, unnest(hits) as token, generate_subscripts(hits, 1) as pos,
                 unnest(list_transform(gaps[1:len(hits)], lambda g: length(g))) as gap
          from (select doc_id, field, {_runs("body")} as hits,
                       string_split_regex(body, {_text(P.WORD_RUN)}) as gaps
                from field_texts))"""
_CTES["kept"] = f"""
    select *, lower(token) as term, count(*) over (partition by doc_id, field) as doc_len
    from spans where lower(token) not in ({_STOP})"""
_CTES["postings"] = """
    select field, term, doc_id, count(*) as freq, any_value(doc_len) as doc_len
    from kept group by field, term, doc_id"""
_INDEX = "corpus articles field_texts spans kept postings"


def _scored(queries: str, field: str) -> str:
    """CTEs scored and matched over the postings of one field."""
    return f"""
, asked as (select query_id, term, count(*) as qtf
            from (select query_id, unnest({_runs("lower(text)")}) as term from {queries})
            where term not in ({_STOP}) group by all),
listed as (select * from postings where field = '{field}'),
stats as (select cast(count(*) as double) as docs, sum(doc_len) / count(*) as mean_len
          from (select distinct doc_id, doc_len from listed)),
term_df as (select term, count(*) as df from listed group by term),
scored as (
    select query_id, doc_id,
           round(sum(qtf * ln(1 + (docs - df + 0.5) / (df + 0.5)) * freq * {P.BM25_K1 + 1}
               / (freq + {P.BM25_K1} * (1 - {P.BM25_B} + {P.BM25_B} * doc_len / mean_len))), 6)
               as score
    from asked join listed using (term) join term_df using (term), stats
    group by all)
"""


_CLEAN_XML = (
    "replace(replace(replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), "
    "'&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
)
_XML_TEXT = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"

_TREEBANK_SQL = [
    (r"\s+", " "),
    (r'[/.,;:@#$%&!?"]', "\n\\0\n"),
    (r"""([^.])([.])([\])}>"']*)\s*$""", "\\1\n\\2\\3\n"),
    (r"[\]\[(){}<>]", "\n\\0\n"),
    (r"--", "\n--\n"),
    (r"([^'])'\s+", "\\1\n'\n"),
    (r"'([sSmMdD])\s+", "\n'\\1\n"),
    (r"(?i)'(ll|re|ve)\s+", "\n'\\1\n"),
    (r"(?i)(n't)\s+", "\n\\1\n"),
    (r"(?i)\s+(can)(not)\s+", "\n\\1\n\\2\n"),
]
_CTES["treebank"] = f"""
    select doc_id, unnest(list_filter(string_split_regex(line, '\\s+'), lambda t: t <> ''))
               as token
    from (select doc_id, {_rules("concat(' ', line, ' ')", _TREEBANK_SQL)} as line
          from (select doc_id, unnest(string_split(body, chr(10))) as line from corpus))"""

_CTES["entity_terms"] = """
    select term, type from lexicon where type is not null
    union all select distinct unnest(regexp_extract_all(text, '[a-z]{9,}', 0)), 'WORD' from benchmark
    union all select distinct unnest(regexp_extract_all(text, '[a-z]+ [a-z]+', 0)), 'PAIR' from benchmark"""
_CTES["word_spans"] = rf"""
    select doc_id, token, stop - length(token) as start, stop,
           lead(token) over w as next_token, lead(stop) over w as next_stop
    from (select doc_id, token, pos,
                 sum(gap + length(token)) over (partition by doc_id order by pos) as stop
          from (select doc_id, unnest(hits) as token, generate_subscripts(hits, 1) as pos,
                       unnest(list_transform(gaps[1:len(hits)], lambda g: length(g))) as gap
                from (select doc_id, {_runs("body")} as hits,
                             string_split_regex(body, {_text(P.WORD_RUN)}) as gaps from corpus)))
    window w as (partition by doc_id order by pos)"""
_CTES["entity_tags"] = r"""
    select doc_id, start, stop, type from word_spans join entity_terms on lower(token) = term
    union all
    select doc_id, start, next_stop, type
    from word_spans join corpus using (doc_id)
    join entity_terms on concat(lower(token), ' ', lower(next_token)) = term
    where next_stop - length(next_token) = stop + 1 and substr(body, cast(stop + 1 as bigint), 1) = ' '
    union all
    select doc_id, begun, begun + 5, 'MARKED'
    from (select doc_id, sum(length(gap) + 5) over (partition by doc_id order by pos) - 5 as begun,
                 pos, parts
          from (select doc_id, unnest(gaps) as gap, generate_subscripts(gaps, 1) as pos,
                       len(gaps) as parts
                from (select doc_id, string_split_regex(body, '\(n=7\)') as gaps from corpus)))
    where pos < parts"""
_CTES["longest_tags"] = """
    select doc_id, start, stop, type from entity_tags
    qualify row_number() over (partition by doc_id, start order by stop desc) = 1"""
_CTES["linked_tags"] = """
    select t.*, o.start as next_start, row_number() over (partition by t.doc_id order by t.start) as n
    from longest_tags t asof left join longest_tags o on t.doc_id = o.doc_id and t.stop <= o.start"""
_CTES["chosen_tags"] = """
    select doc_id, start, stop, type, next_start from linked_tags where n = 1
    union all
    select l.doc_id, l.start, l.stop, l.type, l.next_start
    from chosen_tags c join linked_tags l on c.doc_id = l.doc_id and c.next_start = l.start"""
_CTES["entity_hits"] = """
    select doc_id, body, substr(body, cast(start + 1 as bigint), cast(stop - start as bigint)) as token,
           cast(start as integer) as "start", cast(stop as integer) as "end", type
    from chosen_tags join corpus using (doc_id)"""
_ENTITIES = (
    "corpus lexicon entity_terms word_spans entity_tags longest_tags linked_tags chosen_tags "
    "entity_hits"
)
_CTES["replaced"] = """
    select doc_id, coalesce(new_body, body) as body
    from corpus left join (
        select doc_id, concat(string_agg(substr(body, before + 1, "start" - before), ' maskentity '
                                         order by "start"), ' maskentity ',
                              substr(any_value(body), max("end") + 1)) as new_body
        from (select *, coalesce(lag("end") over (partition by doc_id order by "start"), 0) as before
              from entity_hits) group by doc_id) using (doc_id)"""

# The stemmer, step by step; C, V and the measures are those of the published rules.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_M0 = f"^({_C})?{_V}{_C}"
_M1 = f"^({_C})?{_V}{_C}{_V}{_C}"
_EQ1 = f"^({_C})?{_V}{_C}({_V})?$"
_VOWEL = f"^({_C})?[aeiouy]"
_SHORT = f"^{_C}[aeiouy][^aeiouwxy]$"
_SUFFIXES_2 = (
    "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e "
    "ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous "
    "aliti:al iviti:ive biliti:ble logi:log"
)
_SUFFIXES_3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_SUFFIXES_4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize"


def _cut(n: int) -> str:
    return f"substr(w, 1, length(w) - {n})"


def _m(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '{pattern}')"


def _suffix_sql(table: str) -> str:
    pairs = [entry.split(":") for entry in table.split()]
    longest = "^(.+?)(" + "|".join(s for s, _ in pairs) + ")$"
    stem, suffix = (f"regexp_extract(w, '{longest}', {i})" for i in (1, 2))
    chosen = " ".join(f"when '{s}' then '{r}'" for s, r in pairs)
    return (
        f"case when {suffix} <> '' and {_m(stem, _M0)} "
        f"then {stem} || case {suffix} {chosen} end else w end"
    )


def _stem_steps() -> list[str]:
    past = "regexp_extract(w, '^(.+?)(ed|ing)$', 1)"
    last = "regexp_extract(w, '^(.+?)(" + "|".join(_SUFFIXES_4.split()) + ")$', 1)"
    doubles = "|".join(2 * c for c in "bcdfghjkmnpqrtvwx")
    return [
        "regexp_replace(w, '^y', 'Y')",
        f"case when {_m('w', '^.+(ss|i)es$')} then {_cut(2)} "
        f"when {_m('w', '^.+[^s]s$')} then {_cut(1)} else w end",
        f"case when {_m('w', '^.+eed$')} then "
        f"case when {_m(_cut(3), _M0)} then {_cut(1)} else w end "
        f"when {past} <> '' and {_m(past, _VOWEL)} then {past} || '+' else w end",
        f"case when w not like '%+' then w "
        f"when {_m(_cut(1), '(at|bl|iz)$')} then {_cut(1)} || 'e' "
        f"when {_m(_cut(1), f'({doubles})$')} then {_cut(2)} "
        f"when {_m(_cut(1), _SHORT)} then {_cut(1)} || 'e' else {_cut(1)} end",
        f"case when {_m('w', '^.+y$')} and {_m(_cut(1), _VOWEL)} then {_cut(1)} || 'i' "
        "else w end",
        _suffix_sql(_SUFFIXES_2),
        _suffix_sql(_SUFFIXES_3),
        f"case when {last} <> '' then case when {_m(last, _M1)} then {last} else w end "
        f"when {_m('w', '^.+[st]ion$')} and {_m(_cut(3), _M1)} then {_cut(3)} else w end",
        f"case when {_m('w', '^.+e$')} and ({_m(_cut(1), _M1)} or ({_m(_cut(1), _EQ1)} "
        f"and not {_m(_cut(1), _SHORT)})) then {_cut(1)} else w end",
        f"case when {_m('w', 'll$')} and {_m('w', _M1)} then {_cut(1)} else w end",
        "regexp_replace(w, '^Y', 'y')",
    ]


def _stem_sql() -> str:
    steps = ["s0 as (select distinct term, term as w from letters)"]
    for i, step in enumerate(_stem_steps(), start=1):
        steps.append(
            f"s{i} as (select term, case when length(term) < 3 then w else {step} end as w "
            f"from s{i - 1})"
        )
    return ", " + ",\n".join(steps) + f", stems as (select term, w as stem from s{len(steps) - 1})\n"


_CTES["letters"] = f"""
    select w as term from (select unnest({_runs("lower(body)")}) as w from corpus)
    where regexp_full_match(w, '[a-z]+')"""

_MASKED_OLD = (
    f"regexp_replace({_rules('case when pattern is null then body else regexp_replace(body, pattern, ' + _text(P.ENTITY_MASK) + ', ' + _text('g') + ') end', P.LEXICON_MASK_RULES)}"
    f", {_text(P.PAREN)}, '', 'g')"
)


def _sentence_rows(source: str) -> str:
    sentence = _all("body", P.SENTENCE)
    return (
        f"select doc_id, array_to_string({_tokens('s')}, ' ') as terms from "
        f"(select doc_id, unnest({sentence}) as s from {source}) where len({_tokens('s')}) > 0"
    )


_TURN_TOKENS = (
    "select cast(conv_id as varchar) as doc_id, "
    f"unnest({_tokens('text')}) as term from conversations"
)


def _annotated(body: str, source: str, name: str) -> str:
    """Annotation of one text column."""
    cases = " ".join(
        f"when penn_tag in ({', '.join(_text(t) for t in tags)}) then '{cls}'"
        for cls, tags in P.TAG_CLASSES.items()
    )

    def escaped(x: str) -> str:
        return f"regexp_replace({x}, '^([<>|])$', '//\\1')"

    return f"""
    select doc_id, coalesce(string_agg(
        '<' || {escaped("token")} || '|' || {escaped("coalesce(lemma, lower(token))")} || '|'
        || case {cases} else 'other' end || '|0|0>', ' ' order by pos), '') as {name}
    from (select doc_id from {source}) ids left join (
        select doc_id, unnest(toks) as token, generate_subscripts(toks, 1) as pos
        from (select doc_id, {_tokens(body)} as toks from {source})) using (doc_id)
    left join tags on lower(token) = term
    group by doc_id"""


def build() -> dict[str, str]:
    sql: dict[str, str] = {}
    quantity = _text(P.QUANTITY)

    # sources and sinks
    glued = r"'^[A-Z][a-z]+([A-Zα-ωΑ-Ω])'"
    sql["scan_id_text"] = _with(
        "corpus",
        f"select doc_id, regexp_replace('Abstract' || {_ONE_LINE}, {glued}, '\\1') as body "
        "from corpus",
    )
    sql["scan_tsv_field"] = _with("corpus", f"select doc_id, {_ONE_LINE} as body from corpus")
    sql["scan_tsv_titles"] = _with("corpus", "select doc_id, 'On ' || source as body from corpus")
    sql["scan_index_articles"] = _with(
        "corpus",
        f"select doc_id, 'On ' || source as title, {_KEY} as issn, source as journal, "
        f"{_ONE_LINE} as abstract, lower(doc_id) as id_key from corpus",
    )
    sql["scan_categories"] = _with("cats", "select * from cats")
    sql["scan_terms"] = (
        "select distinct term from (select unnest(string_split_regex(text, '\\s+')) as term "
        "from benchmark) where term <> ''"
    )
    sql["load_table"] = _with("corpus", "select doc_id, body from corpus")
    sql["save_roundtrip"] = _with(
        "corpus",
        'select doc_id, token, count(*) as "count" from '
        f"(select doc_id, unnest({_tokens('body')}) as token from corpus) group by all",
    )
    readable = "from documents where source <> 'src7'"
    names = "concat('S', n_chars, '.xml') as file_name, concat('S', doc_id, 'x') as \"PII\""
    sql["xml_fields"] = (
        f"select {names}, concat('On ', source) as \"Title\", "
        "regexp_extract(source, '[0-9]+', 0) as \"ISSN\", "
        "concat('Writer ', lang, ' Second Writer') as \"Authors\", 'Volume 1' as \"Volume\", "
        "'2018-01-01' as \"PubTime\", concat(doc_id, '-', doc_id + 9) as \"Pages\", "
        f'{_XML_TEXT} as "Abstract" {readable}'
    )
    sql["xml_tree"] = sql["xml_fields"].replace("concat('S', n_chars, '.xml') as file_name, ", "")
    sql["xml_ids"] = (
        f"select {names}, concat('10.1/', doc_id) as \"DOI\", "
        "cast(doc_id as varchar) as \"PMID\", concat('2-s2.0-', doc_id) as \"EID\" "
        f"{readable}"
    )
    sql["dedupe_by_name"] = (
        "select file_name, min(concat('/tree/', source, '/', doc_id, '/', file_name)) as path "
        "from (select *, concat('S', n_chars, '.xml') as file_name from documents) "
        "group by file_name"
    )
    sql["report_lines"] = _with(
        "corpus",
        "select concat(doc_id, chr(9), source, chr(9), "
        "regexp_replace(body, '\\t+', ' ', 'g')) as value from corpus",
    )

    # rewriting
    sql["unglue_heading"] = _with(
        "corpus",
        f"select doc_id, regexp_replace('Abstract' || body, {glued}, '\\1') as body from corpus",
    )
    masked = _rules("body", P.MASK_RULES)
    sql["mask_patterns"] = _with("corpus", f"select doc_id, {masked} as body from corpus")
    sql["mask_lexicon"] = _with(
        _NAMES, f"select doc_id, {_MASKED_OLD} as body from corpus left join name_pattern using (doc_id)"
    )
    sql["filter_masked"] = _with(
        "corpus",
        f"select doc_id from (select doc_id, {masked} as body from corpus) "
        "where body like '%maskentity%' or body like '%maskpct%' or body like '%masknum%' "
        "or body like '%maskparen%'",
    )
    sql["extract_matches"] = _with(
        "corpus",
        f"select doc_id, unnest(regexp_extract_all(body, {_text(P.NUMBER)}, 0)) as match "
        "from corpus",
    )
    groups = ", ".join(
        f"unnest(regexp_extract_all(body, {quantity}, {i})) as {name}"
        for i, name in ((1, "sign"), (2, "number"), (3, "unit"))
    )
    sql["extract_numerics"] = _with("corpus", f"select doc_id, {groups} from corpus")

    # seeds and names
    sql["mine_seeds"] = _with("corpus shapes mined", "select seed from mined")
    with_words = "corpus dictionary shapes mined word_seeds"
    sql["clean_seeds"] = _with(
        with_words,
        "select seed from word_seeds where seed not in "
        "(select term from dictionary where length(term) <= 8) "
        f"and not regexp_matches(seed, {_text(P.NOT_LATIN_GREEK)})",
    )
    sql["seeds_in_dictionary"] = _with(
        with_words, "select seed from word_seeds where seed in (select term from dictionary)"
    )
    sql["seed_heads"] = _with(
        with_words, "select distinct substr(seed, 1, 6) as head from word_seeds"
    )
    sql["lexicon_matches"] = _with(
        _NAMES,
        "select distinct unnest(regexp_extract_all(body, pattern, 0)) as match "
        "from corpus join name_pattern using (doc_id)",
    )
    entity = _ENTITIES
    sql["tag_entities"] = _with(
        entity,
        'select doc_id, "start", "end", token as text, type '
        "from corpus left join entity_hits using (doc_id)",
    )
    sql["entity_context"] = _with(
        entity,
        'select doc_id, type, substr(body, greatest("start" - 10, 0) + 1, '
        'least("start", 10)) as "before", token as text, '
        'substr(body, "end" + 1, 5) as "after" from entity_hits',
    )
    sql["replace_entities"] = _with(_ENTITIES + " replaced", "select doc_id, body from replaced")

    # tokens
    sql["tokenize_sentences"] = _with("corpus", _sentence_rows("corpus"))
    sql["sentence_terms"] = _with(
        "corpus", f"select terms from ({_sentence_rows('corpus')})"
    )
    sql["terms_lower"] = _with(
        "corpus",
        f"select doc_id, lower(terms) as terms from ({_sentence_rows('corpus')})",
    )
    pairs = f"select unnest({_tokens('body')}) as token, doc_id from corpus"
    sql["token_pairs"] = _with("corpus", pairs)
    sql["tokens_per_doc"] = _with(
        "corpus",
        f"select doc_id, array_to_string({_tokens('body')}, ' ') as tokens from corpus",
    )
    sql["token_freq_per_doc"] = _with(
        "corpus",
        f'select doc_id, token, count(*) as "count" from ({pairs}) '
        "where length(token) > 3 group by all",
    )
    sql["token_freq_all"] = _with(
        "corpus", f'select doc_id, token, count(*) as "count" from ({pairs}) group by all'
    )
    turns = "select cast(conv_id as varchar) as doc_id, text as body from conversations"
    turn_words = _CTES["words"].replace("from corpus", "from turns")
    sql["turn_term_counts"] = (
        f"with turns as ({turns}), words as ({turn_words}), dictionary as ({_CTES['dictionary']}), "
        "bag as (select doc_id, term, count(*) as n from words "
        "where term not in (select term from dictionary) group by all) "
        'select doc_id, term, coalesce(n, 0) as "count" '
        "from (select distinct doc_id from turns) left join bag using (doc_id)"
    )
    sql["sentence_stems"] = (
        f"with turns as ({turns}), numbered as (select row_number() over () as place, doc_id, s "
        f"from (select doc_id, unnest({_all('body', P.SENTENCE)}) as s from turns)), "
        f"cut as (select place, doc_id, {_tokens('lower(s)')} as hits from numbered), "
        "pieces as (select place, doc_id, unnest(hits) as term, generate_subscripts(hits, 1) as pos "
        "from cut), letters as (select term from pieces)"
        + _stem_sql()
        + "select doc_id, string_agg(stem, ' ' order by pos) as terms from pieces join stems "
        "using (term) group by place, doc_id"
    )
    sql["terms_stem"] = _with("corpus letters", _stem_sql() + "select * from stems")
    sql["pattern_term_counts"] = _with(
        "corpus words bag dictionary",
        'select doc_id, b.term, coalesce(n, 0) as "count" from corpus left join '
        "(select * from bag where term not in (select term from dictionary)) b using (doc_id)",
    )
    sql["stemmed_term_counts"] = _with(
        "corpus letters words bag dictionary",
        _stem_sql() + ", stemmed as (select doc_id, stem as term, sum(n) as n from bag "
        "join stems using (term) where stem not in (select term from dictionary) "
        'group by all) select doc_id, term, cast(coalesce(n, 0) as bigint) as "count" '
        "from corpus left join stemmed using (doc_id)",
    )
    sql["ptb_tokens"] = _with("corpus treebank", "select doc_id, token from treebank")
    sql["token_shapes"] = _with(
        "corpus treebank",
        r"""select case when regexp_full_match(t, '[a-z]+') or regexp_full_match(t, '[\x00-\x7F]')
                        then t
                   when regexp_full_match(t, '[0-9]+') then '0'
                   when regexp_matches(t, '^[0-9]') then 'NUM'
                   when regexp_matches(t, '[0-9]') then 'NUMX'
                   else 'CPLX' end as shape, count(*) as n
            from (select translate(regexp_replace(token, '^Abstract(.)', '\1'),
                                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
                  from treebank) group by 1""",
    )
    sql["annotate_tokens"] = _with("corpus lexicon tags", _annotated("body", "corpus", "annotated"))
    sql["annotation_lines"] = _with(
        "corpus lexicon tags",
        f", a as ({_annotated('body', 'corpus', 'annotated')}) "
        "select concat(doc_id, chr(9), '1', chr(9), annotated) as value from a",
    )
    sql["annotate_articles"] = _with(
        "corpus articles lexicon tags",
        f", a as ({_annotated('title', 'articles', 'title')}), "
        f"b as ({_annotated('abstract', 'articles', 'abstract')}) "
        "select doc_id, issn, a.title, b.abstract from a join b using (doc_id) "
        "join articles using (doc_id)",
    )
    sql["oov_counts"] = _with(
        "corpus dictionary",
        'select term, count(*) as "count" from (select lower(w) as term from '
        f"(select unnest({_plain('body')}) as w from corpus)) "
        "where term not in (select term from dictionary) group by term order by term",
    )

    # counts and weights
    sql["bow_per_doc"] = f'select doc_id, term, count(*) as "count" from ({_TURN_TOKENS}) group by all'
    sql["doc_freq"] = _with("corpus words bag freqs", "select * from freqs")
    sql["doc_count"] = f"select count(distinct doc_id) as num_docs from ({_TURN_TOKENS})"
    sql["tfidf"] = _with(_WEIGHTS, "select doc_id, term, round(weight, 6) as weight from weighted")
    sql["weights_by_term"] = _with(
        _WEIGHTS, "select term, doc_id, round(weight, 6) as weight from weighted"
    )
    masked_corpus = f", masked as (select doc_id, {masked} as body from corpus)"
    sql["tfidf_top_terms"] = _with(
        "corpus",
        masked_corpus
        + ", m_words as ("
        + _CTES["words"].replace("from corpus", "from masked")
        + """), m_bag as (select doc_id, term, count(*) as n from m_words group by all),
        m_freqs as (select term, count(*) as df from m_bag group by term),
        w as (select doc_id, term,
                     round(n / sum(n) over (partition by doc_id) * ln(docs.c / df), 6) as weight
              from m_bag join m_freqs using (term),
                   (select cast(count(*) as double) as c from corpus) docs)
        select * from (select *, row_number() over (partition by doc_id
                              order by weight desc, term) as rank from w) where rank <= 10""",
    )
    sql["sample_rows"] = _with(
        "corpus", f"select doc_id from corpus where {_HASH.format('doc_id')} < 30"
    )

    # vectors
    sql["top_vocabulary"] = _with(
        "corpus words bag freqs dictionary",
        "select term, df, row_number() over (order by df desc, term) - 1 as term_id from freqs "
        "where term not in (select term from dictionary) order by df desc, term limit 10000",
    )
    sql["term_vectors"] = _with(
        _WEIGHTS + " ranked_terms",
        "select doc_id, term_id, round(weight, 6) as weight from weighted "
        f"join ranked_terms using (term) where term_id < 10000",
    )
    sql["cooccurrence"] = _with(
        _WEIGHTS + " ranked_terms",
        ", c as (select doc_id, term_id, weight from weighted join ranked_terms using (term) "
        "where term_id < 10000 and weight <> 0) select a.term_id as i, b.term_id as j, "
        "round(sum(a.weight * b.weight), 6) as value "
        "from c a join c b on a.doc_id = b.doc_id and a.term_id <= b.term_id group by all",
    )
    sql["lsi_norms"] = "select unnest(range(100)) as k, 1.0::double as u_norm, 1.0::double as v_norm"
    full = "from weighted join ranked_terms using (term) where term_id < 64"
    sql["lsi_energy"] = _with(_WEIGHTS + " ranked_terms", f"select round(sum(weight * weight), 6) as energy {full}")
    sql["lsi_reconstruction"] = _with(
        _WEIGHTS + " ranked_terms", f"select doc_id, term_id, round(weight, 6) + 0 as weight {full}"
    )
    sql["saved_tokens"] = sql["sentence_terms"]
    sql["saved_token_pairs"] = sql["token_pairs"]
    turn_lower = _TURN_TOKENS.replace("unnest(", "lower(unnest(").replace(" as term", ") as term")
    sql["word2vec_vocabulary"] = (
        f"select term, cast(100 as bigint) as dim from (select term, count(*) as n from ({turn_lower}) group by term) where n >= 5"
    )
    sentence = (
        "select row_number() over () as id, s from (select unnest("
        + _all("text", P.SENTENCE) + ") as s from conversations)"
    )
    sentence_tokens = f"""select id, unnest(list_transform({_tokens("s")}, lambda t: lower(t))) as term,
        generate_subscripts({_tokens("s")}, 1) as pos from sentences"""
    near = f"""with sentences as ({sentence}), placed as ({sentence_tokens}),
        frequent as (select term from placed group by term having count(*) >= 5),
        kept as (select * from placed semi join frequent using (term)),
        near as (select a.term, b.term as context, count(*) as n from kept a join kept b
                 on a.id = b.id and a.pos <> b.pos and abs(a.pos - b.pos) <= 5 group by all)"""
    sql["window_counts"] = f"{near} select * from near"
    sql["pmi_weights"] = f"""{near}, sums as (select term, sum(n)::double as own from near group by term)
        select * from (select n.term, context, round(ln(n.n * (select sum(n)::double from near) / (a.own * b.own)) - ln(2), 6) + 0 as weight
        from near n join sums a on n.term = a.term join sums b on context = b.term) where weight > 0"""
    sql["pmi_vectors"] = _with(
        "corpus",
        "select term, cast(100 as bigint) as dim from (select term, count(*) as n from (select unnest(list_transform("
        f"{_tokens('s')}, lambda t: lower(t))) as term from (select unnest({_all('body', P.SENTENCE)}) as s from corpus)) group by term) where n >= 5",
    )
    sql["join_vectors_weights"] = _with(
        _WEIGHTS + " ranked_terms wv",
        "select doc_id, round(weight, 6) as weight, "
        "round(list_sum(list_transform(vec, lambda x: cast(x as double))), 6) + 0 as vec_sum "
        "from weighted join wv using (term)",
    )
    sql["doc_vectors_weighted"] = _with(
        _WEIGHTS + " ranked_terms wv wv_cells",
        "select doc_id, pos, round(sum(weight * cast(x as double)) / nullif(sum(weight), 0), 6) "
        "+ 0 as value from weighted join wv_cells using (term) group by all",
    )
    sql["doc_vectors_mean"] = _with(_MEANS, "select doc_id, pos, round(value, 6) + 0 as value from means")

    # categories and labels
    sql["category_index"] = _with("cats cat_index", "select * from cat_index")
    sql["key_to_name"] = _with(
        "cats", f"select {_ISSN} as issn, min(journal) as journal from cats group by 1"
    )
    sql["multi_hot"] = _with(
        "cats cat_index journals",
        "select issn, array_to_string(categories, ' ') as categories, "
        "string_agg(case when list_contains(categories, category) then '1' else '0' end, ' ' "
        "order by category_id) as hot from journals, cat_index group by issn, categories",
    )
    sql["saved_categories"] = sql["multi_hot"]
    cats = "cats cat_index journals single"
    unique = (
        "coalesce(category_id, (select count(*) from cat_index)) as category"
    )
    sql["label_unique"] = _with(
        "corpus " + cats,
        f"select doc_id, {unique} from corpus left join single on {_KEY} = issn",
    )
    fixed = "cast(cast(value as decimal(38,5)) as varchar)"
    sql["label_lines"] = _with(
        _MEANS + " " + cats,
        f"select concat({unique.removesuffix(' as category')}, ',', coords) as value from "
        f"(select doc_id, string_agg({fixed}, ',' order by pos) as coords from means "
        f"group by doc_id) left join single on {_KEY} = issn",
    )
    every = (
        f"select doc_id, category_id as category from corpus join (select issn, "
        f"unnest(categories) as category from journals) j on {_KEY} = issn "
        "join cat_index using (category)"
    )
    sql["label_all"] = _with("corpus cats cat_index journals", every)
    side = f"case when {_HASH.format('doc_id')} < 80 then 'train' else 'test' end as side"
    sql["split_groups"] = _with(
        "corpus cats cat_index journals", f"select doc_id, category, {side} from ({every})"
    )
    sql["saved_training"] = f"select doc_id, {side} from (select cast(vec_id as varchar) as doc_id from embeddings)"
    sql["split_rows"] = _with("corpus", f"select doc_id, {side} from corpus")
    targets = (
        "select issn, row_number() over (order by issn) - 1 as target "
        f"from (select distinct {_KEY} as issn from corpus)"
    )
    sql["target_index"] = _with("corpus", targets)
    sql["labeled_points"] = _with(
        _MEANS,
        f", t as ({targets}) select doc_id, cast(target as double) as label, pos, "
        f"round(value, 6) + 0 as value from means join t on {_KEY} = issn",
    )
    sql["mean_from_sums"] = sql["doc_vectors_mean"]
    sql["export_vectors"] = _with(
        _MEANS,
        f"select concat({_KEY}, chr(9), string_agg({fixed}, chr(9) order by pos)) as value "
        "from means group by doc_id",
    )

    # search
    sql["build_postings"] = _with(
        _INDEX.removesuffix(" postings"),
        """select field, term, doc_id, count(*) as freq,
                  string_agg(cast(pos as varchar), ' ' order by pos) as positions,
                  string_agg(concat(cast(stop - length(token) as bigint), '-',
                                    cast(stop as bigint)), ' ' order by pos) as offsets,
                  any_value(doc_len) as doc_len
           from kept group by field, term, doc_id
           union all select 'issn', issn, doc_id, 1, '', '', 1 from articles""",
    )
    sql["index_size"] = _with("corpus", "select count(*) as num_docs from corpus")
    sql["lookup_id"] = _with(
        "corpus articles",
        "select doc_id, title, issn, journal, abstract from articles "
        "where lower(doc_id) = 's0000000300000003'",
    )
    sql["search_top"] = _with(
        _INDEX,
        ", one as (select 0 as query_id, 'the station of anderhe, and ing' as text)"
        + _scored("one", "title")
        + "select doc_id, score, title, issn, journal, abstract, "
        "(select count(*) from scored) as total from scored join articles using (doc_id) "
        "order by score desc, doc_id limit 20",
    )
    batch = ", many as (select item_id as query_id, text from benchmark)" + _scored(
        "many", "abstract"
    )
    sql["search_batch"] = _with(
        _INDEX,
        batch + "select query_id, rank, doc_id, score from (select *, row_number() over "
        "(partition by query_id order by score desc, doc_id) as rank from scored) "
        "where rank <= 10",
    )
    sql["search_hits"] = _with(
        _INDEX,
        batch + "select query_id, count(doc_id) as hits from many "
        "left join scored using (query_id) group by query_id",
    )

    # composite jobs
    mined = _rules("body", P.MASK_RULES)
    mined_bag = (
        f", mined_docs as (select doc_id, {mined} as body from replaced), "
        f"mined_bag as (select doc_id, term, count(*) as n from (select doc_id, "
        f"lower(unnest({_tokens('body')})) as term from mined_docs) group by all), "
        "mined_df as (select term, count(*) as df from mined_bag group by term)"
    )
    sql["mined_tfidf"] = _with(
        _ENTITIES + " replaced",
        mined_bag + "select doc_id, term, round(n / sum(n) over (partition by doc_id) "
        "* ln((select cast(count(distinct doc_id) as double) from mined_bag) / df), 6) as weight "
        "from mined_bag join mined_df using (term)",
    )
    plain_masked = f"select doc_id, {masked} as body from corpus"
    sql["mined_again"] = _with(
        "corpus",
        f"select term, count(distinct doc_id) as df from (select doc_id, "
        f"unnest({_tokens('body')}) as term from ({plain_masked})) group by term",
    )
    old = f", old as (select doc_id, {_MASKED_OLD} as body from corpus left join name_pattern using (doc_id))"
    sql["masked_sentence_terms"] = _with(
        _NAMES, old + f" select terms from ({_sentence_rows('old')})"
    )
    return sql
