r"""PII surrogates in Spark SQL: keyed, type-consistent replacements.

One ordered alternation of patterns finds secrets, access keys, e-mail addresses, IP
addresses, social security numbers, bank accounts, cards, phones and titled or given names.
Each occurrence is replaced by a surrogate that depends on the key and the entity alone, so
that an entity keeps one surrogate in all texts (coreference):

* digits of IP addresses, cards, phones, bank accounts and social security numbers pass a
  keyed Feistel permutation of their domain, which is one to one and so keeps entities
  distinct; signs around the digits stay, a card keeps its first digit and its Luhn remainder,
  a phone its country code or trunk digit. A bank account keeps its country; its letters are
  shifted by keyed steps that depend on its digits, and its check digits restore the remainder
  by 97 (checks of 97 to 99, which no valid account has, count as 0 to 2);
* given names pass a keyed rotation of the list of their gender and script, also one to one;
  titles stay, so a surname keeps its gender, and capitals stay capitals;
* e-mail names, secrets, access keys and surnames are drawn sign by sign from a keyed digest,
  letters for letters and digits for digits. ``collision_free_width`` checks over all distinct
  entities of the corpus that their surrogates are distinct and no surrogate is an entity, and
  widens the surrogates of a type until that holds.

A type that still collides at the limit raises an error. Digits may equal another real number
of the corpus: the permutation covers the whole domain, real numbers included.

A null text stays null, an empty one empty; both have no entities. Repeated rows are replaced
alike; of patterns that match at one place the first of the list wins. Whole texts are scanned,
and the time of a very long entity grows with its length. An empty table gives an empty result;
other columns pass through. Only DataFrame and SQL functions run.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget_parses

# Given names by gender and script, titles by gender.
GIVEN = {
    ("m", "latin"): "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Steven Paul Andrew Peter Hans Jürgen Klaus Stefan Wolfgang Pierre Jean Jacques Michel Philippe José Juan Carlos Luis Miguel Javier".split(),
    ("f", "latin"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Ashley Emily Anna Laura Ursula Monika Petra Sabine Renate Marie Nathalie Isabelle Sylvie Catherine María Carmen Ana Isabel Lucía Pilar".split(),
    ("m", "cyrillic"): "Иван Сергей Алексей Дмитрий Андрей Михаил Николай Владимир Павел Олег".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Юлия Екатерина".split(),
}
TITLES = {"m": ["Mr.", "Herr", "Monsieur", "Señor", "Sr.", "г-н", "господин"], "f": ["Mrs.", "Ms.", "Miss", "Frau", "Madame", "Mme.", "Señora", "Sra.", "г-жа", "госпожа"], "n": ["Dr.", "Prof."]}

# Titles in capitals, and phrases that a person's name follows.
LOUD = ["MR.", "MRS.", "MS.", "DR.", "PROF.", "HERR", "FRAU"]
CUES = ["my name is ", "My name is ", "contact: ", "Contact: ", "signed by ", "Signed by ", "Regards, ", "regards, ", "ich heiße ", "Ich heiße ", "je m'appelle ", "Je m'appelle ", "me llamo ", "Me llamo "]

_WORD = r"\p{Lu}[\p{Ll}'’]+"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_CAPS = r"\p{Lu}[\p{Lu}'’-]+"
_TITLE = "|".join(t.replace(".", r"\.") for g in TITLES.values() for t in g)
_LOUD = "|".join(t.replace(".", r"\.?") for t in LOUD)
_CUE = "(?<=" + "|".join(CUES) + ")"
_GIVEN = "|".join(n for names in GIVEN.values() for n in names)
#: (type, pattern), tried in this order at each place of the text; each begins with a look at
#: the first sign, so that most places fail at once.
PATTERNS = [
    ("secret", r"""(?=[pstaPSTA])(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth)\b["']?\s{0,3}[=:]\s{0,3}["']?)[A-Za-z0-9+/_\-]{6,}+={0,2}"""),
    ("access_key", r"(?=[Ags])(?:\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\b(?:ghp|gho|ghs)_[A-Za-z0-9]{36}\b|\bsk-[A-Za-z0-9]{20,}\b)"),
    # A host name has 127 labels at most; a group without bound would be matched recursively.
    ("email", r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++){1,126}"),
    ("ip", rf"(?=\d)(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)"),
    ("iban", r"(?=[A-Z])\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("ssn", r"(?=\d)(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("phone", r"(?=[+(\d])(?:(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\w+])\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\w.+-])(?:1[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-])|(?<![\w.,+/-])0\d(?:[ .]\d{2}){4}(?![\d-])|(?<![\w.,+/-])0\d{2,4}[ /]\d{5,8}(?![\d-]))"),
    ("card", r"(?=\d)(?<![\d.])\d(?:[ -]?\d){12,18}(?!\d)"),
    ("name", rf"(?=[\p{{Lu}}г])(?<![\p{{L}}\d])(?:(?:{_TITLE}) {_WORD}(?:[ -]{_WORD}){{0,2}}|(?:{_LOUD}) {_CAPS}|(?:{_GIVEN})(?:-{_WORD})? {_WORD}(?:-{_WORD})?|{_CUE}{_WORD} {_WORD}(?:-{_WORD})?)"),
]
ALL_TITLES = [*[t for g in TITLES.values() for t in g], *LOUD, *[t.rstrip(".") for t in LOUD if t.endswith(".")]]
ANY = "|".join(f"(?:{p})" for _, p in PATTERNS)
#: Every text with an entity has one of these signs, or a name.
GATE = r"[\d@=:]"
DRAWN = ("secret", "access_key", "email", "name")
KEY, ROUNDS = "surrogates-1", 6
DEFAULT_WIDTH = 8


def lit(text: str) -> str:
    return "r'" + text.replace("'", r"\x27") + "'" if "\\" in text or "'" in text else f"'{text}'"


def type_of(e: str) -> str:
    """The first type whose pattern takes the whole entity; what needs its context to match is a name."""
    return "CASE " + " ".join(f"WHEN {e} RLIKE {lit('^(?:' + p + ')$')} THEN '{t}'" for t, p in PATTERNS[:-1]) + " ELSE 'name' END"


def _number(parts: str, modulus: str) -> str:
    """A keyed number below ``modulus`` (long), drawn from a digest of ``parts``."""
    return f"pmod(cast(conv(substr(sha2(concat_ws('|', {parts}), 256), 1, 15), 16, 10) AS bigint), {modulus})"


def feistel(digits: str, key: str, kind: str) -> str:
    """Keyed permutation of the digit strings of each length."""
    left, right = f"substr({digits}, 1, length({digits}) div 2)", f"substr({digits}, length({digits}) div 2 + 1)"

    def add(side: str, other: str) -> str:
        size = f"length(s.{side})"
        mod = f"cast(pow(10, {size}) AS bigint)"
        return f"lpad(cast(pmod(cast(concat('0', s.{side}) AS bigint) + {_number(f'{lit(key)}, {lit(kind)}, cast(i AS string), length({digits}), s.{other}', mod)}, {mod}) AS string), {size}, '0')"

    step = f"CASE WHEN i % 2 = 0 THEN named_struct('l', {add('l', 'r')}, 'r', s.r) ELSE named_struct('l', s.l, 'r', {add('r', 'l')}) END"
    return f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', {left}, 'r', {right}), (s, i) -> {step}, s -> concat(s.l, s.r))"


def placed(e: str, signs: str, kind: str = "[0-9]") -> str:
    """The signs put in the places of those of ``e`` of one kind; for short entities."""
    return f"aggregate(split({e}, ''), named_struct('o', '', 'k', 1, 'd', {signs}), (y, x) -> CASE WHEN x RLIKE '^{kind}$' THEN named_struct('o', concat(y.o, substr(y.d, y.k, 1)), 'k', y.k + 1, 'd', y.d) ELSE named_struct('o', concat(y.o, x), 'k', y.k, 'd', y.d) END, y -> y.o)"


def only_digits(e: str) -> str:
    return f"regexp_replace({e}, '[^0-9]', '')"


def ip(e: str, key: str) -> str:
    """Feistel over the two halves of the address."""
    part = lambda k: f"cast(split({e}, '[.]')[{k}] AS bigint)"
    step = f"CASE WHEN i % 2 = 0 THEN named_struct('l', pmod(s.l + {_number(f'{lit(key)}, {lit("ip")}, cast(i AS string), cast(s.r AS string)', '65536')}, 65536), 'r', s.r) ELSE named_struct('l', s.l, 'r', pmod(s.r + {_number(f'{lit(key)}, {lit("ip")}, cast(i AS string), cast(s.l AS string)', '65536')}, 65536)) END"
    return f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', {part(0)} * 256 + {part(1)}, 'r', {part(2)} * 256 + {part(3)}), (s, i) -> {step}, s -> concat_ws('.', cast(s.l div 256 AS string), cast(s.l % 256 AS string), cast(s.r div 256 AS string), cast(s.r % 256 AS string)))"


def luhn(digits: str) -> str:
    """Luhn sum, modulo 10, of digits whose last one is the check digit."""
    d = f"cast(substr({digits}, length({digits}) - j, 1) AS int)"
    return f"pmod(aggregate(sequence(0, length({digits}) - 1), 0L, (t, j) -> t + CASE WHEN j % 2 = 0 THEN {d} ELSE ({d} * 2) div 10 + ({d} * 2) % 10 END), 10)"


def card(e: str, key: str) -> str:
    """Inner digits permuted; the last digit restores the Luhn remainder."""
    d = "c.d"
    body = f"concat(substr({d}, 1, 1), {feistel(f'substr({d}, 2, length({d}) - 2)', key, 'card')})"
    check = f"aggregate(array({body}), '', (z, b) -> concat(b, cast(pmod({luhn(d)} - {luhn("concat(b, '0')")}, 10) AS string)))"
    return placed(e, f"aggregate(array(named_struct('d', {only_digits(e)})), '', (y, c) -> {check})")


def drawn(e: str, seed: str, key: str, width: str) -> str:
    """Sign by sign from a keyed digest: letters for letters of the case, digits for digits.

    Shorter texts than ``width`` are lengthened with letters.
    """
    block = lambda k: f"sha2(concat_ws('|', {lit(key)}, '{k}', {seed}), 512)"
    code = "cast(conv(substr(a.h, (k % 128) * 2 + 1, 2), 16, 10) AS int)"
    pick = f"CASE WHEN c RLIKE '^[0-9]$' THEN cast({code} % 10 AS string) WHEN a.x AND c RLIKE '^[a-f]$' THEN substr('abcdef', {code} % 6 + 1, 1) WHEN c RLIKE '^[a-z]$' THEN char(97 + {code} % 26) WHEN c RLIKE '^[A-Z]$' THEN char(65 + {code} % 26) ELSE c END"
    start = f"named_struct('h', concat({block(0)}, {block(1)}), 'x', {e} RLIKE '^[0-9a-f]+$')"
    long = f"concat({e}, repeat('x', greatest(0, {width} - length({e}))))"
    return f"element_at(transform(array({start}), a -> array_join(transform(split({long}, ''), (c, k) -> {pick}), '')), 1)"


def mod97(s: str) -> str:
    """Remainder by 97 of digits and capitals, A as 10 to Z as 35."""
    return f"aggregate(split({s}, ''), 0, (r, z) -> CASE WHEN z RLIKE '^[0-9]$' THEN (r * 10 + cast(z AS int)) % 97 WHEN z RLIKE '^[A-Z]$' THEN (r * 100 + ascii(z) - 55) % 97 ELSE r END)"


def iban(e: str, key: str) -> str:
    """Country, check digits that keep the remainder by 97, account with permuted digits and shifted letters."""
    account, digits = "substr(q.p, 5)", only_digits("substr(q.p, 5)")
    step = _number(f"{lit(key)}, 'iban', cast(m AS string), g.d", "26")
    shifted = f"array_join(transform(split(g.w, ''), (c, m) -> CASE WHEN c RLIKE '^[A-Z]$' THEN char(65 + pmod(ascii(c) - 65 + {step}, 26)) ELSE c END), '')"
    new = f"element_at(transform(array(named_struct('d', {feistel(digits, key, 'iban')}, 'w', {account})), g -> {placed(shifted, 'g.d')}), 1)"
    whole = f"transform(array(named_struct('p', regexp_replace({e}, '[^A-Z0-9]', ''))), q -> named_struct('c', substr(q.p, 1, 2), 'n', {new}, 'r', {mod97('concat(substr(q.p, 5), substr(q.p, 1, 4))')}))"
    check = f"lpad(cast(pmod(o.r - {mod97("concat(o.n, o.c, '00')")}, 97) AS string), 2, '0')"
    return placed(e, f"element_at(transform({whole}, o -> concat(o.c, {check}, o.n)), 1)", "[A-Z0-9]")


def email(e: str, key: str, width: str) -> str:
    ending = f"regexp_extract({e}, '[.](com|org|net|de|fr|es)$', 1)"
    return f"concat({drawn(f"substring_index({e}, '@', 1)", f"'email', lower({e})", key, width)}, '@example.', CASE WHEN {ending} = '' THEN 'org' ELSE {ending} END)"


def secret(e: str, key: str, width: str) -> str:
    head = r"""^(.*?[=:]\s{0,3}["']?)(.*)$"""
    value = f"regexp_extract({e}, {lit(head)}, 2)"
    return f"concat(regexp_extract({e}, {lit(head)}, 1), {drawn(value, f"'secret', {value}", key, width)})"


def access_key(e: str, key: str) -> str:
    head = "^(AKIA|ASIA|gh[pos]_|sk-)(.*)$"
    value = f"regexp_extract({e}, '{head}', 2)"
    return f"concat(regexp_extract({e}, '{head}', 1), {drawn(value, f"'access_key', {value}", key, '0')})"


def surname(w: str, key: str, width: str) -> str:
    """Syllables in the word's script, from a keyed digest."""
    digest = f"sha2(concat_ws('|', {lit(key)}, 'surname', lower({w})), 256)"

    def syllables(first: str, second: str) -> str:
        at = lambda k: f"cast(conv(substr({digest}, {k}, 1), 16, 10) AS int)"
        return f"array_join(transform(sequence(0, greatest(2, {width} div 2) - 1), k -> concat(substr('{first}', {at('k * 2 + 1')} + 1, 1), substr('{second}', {at('k * 2 + 2')} % 4 + 1, 1))), '')"

    drawn_name = f"CASE WHEN {w} RLIKE '[\\\\x{{0400}}-\\\\x{{04FF}}]' THEN {syllables('бвгджзклмнпрстфх', 'аеио')} ELSE {syllables('bcdfghklmnprstvz', 'aeio')} END"
    return f"CASE WHEN length({w}) > 1 AND {w} = upper({w}) THEN upper({drawn_name}) ELSE initcap({drawn_name}) END"


def person(e: str, key: str, width: str) -> str:
    """Word by word: titles stay, given names rotate in their list, other words are surnames."""
    titles = ", ".join(f"'{t}'" for t in ALL_TITLES)
    cases = []
    for (gender, script), names in GIVEN.items():
        shift = f"(1 + {_number(f"{lit(key)}, 'given', '{gender}', '{script}'", str(len(names) - 1))})"
        listed = "array(" + ", ".join(f"'{n}'" for n in names) + ")"
        cases.append(f"WHEN array_contains({listed}, v) THEN {listed}[cast(pmod(array_position({listed}, v) - 1 + {shift}, {len(names)}) AS int)]")
    return f"array_join(transform(split({e}, ' '), w -> CASE WHEN w IN ({titles}) THEN w ELSE array_join(transform(split(w, '-'), v -> CASE {' '.join(cases)} ELSE {surname('v', key, width)} END), '-') END), ' ')"


def surrogate(e: str, kind: str, key: str, widths: dict[str, int]) -> str:
    w = {t: str(widths.get(t, DEFAULT_WIDTH)) for t in DRAWN}
    trunk = "^(?:[+][0-9]{1,3}(?=[ .(-])|0|1(?=[ .-]))"
    phone_digits = f"regexp_replace({e}, '{trunk}', '')"
    phone = f"concat(regexp_extract({e}, '{trunk}', 0), {placed(phone_digits, feistel(only_digits(phone_digits), key, 'phone'))})"
    return f"""CASE {kind} WHEN 'secret' THEN {secret(e, key, w['secret'])} WHEN 'access_key' THEN {access_key(e, key)} WHEN 'email' THEN {email(e, key, w['email'])}
        WHEN 'ip' THEN {ip(e, key)} WHEN 'iban' THEN {iban(e, key)} WHEN 'ssn' THEN {placed(e, feistel(only_digits(e), key, 'ssn'))}
        WHEN 'phone' THEN {phone} WHEN 'card' THEN {card(e, key)} WHEN 'name' THEN {person(e, key, w['name'])} ELSE {e} END"""


def occurrences(text: str) -> Column:
    """All entities of a text in order of their places; an empty array for null."""
    found = f"regexp_extract_all({text}, {lit(ANY)}, 0)"
    return F.expr(f"CASE WHEN {text} RLIKE {lit(GATE)} OR {text} RLIKE {lit(dict(PATTERNS)['name'])} THEN {found} ELSE cast(array() AS array<string>) END")


def collision_free_width(docs: DataFrame, text_col: str = "text", key: str = KEY, limit: int = 32) -> dict[str, int]:
    """Widths of drawn surrogates at which all distinct entities have distinct surrogates.

    Entities are made distinct in parallel before they are compared, and only a count for each
    type reaches the driver. A type that collides is widened by 4 signs and checked again.
    """
    text = docs.select(F.col(text_col).alias("__t"))
    found = text.select(F.explode(occurrences("__t")).alias("e")).distinct().select("e", F.expr(type_of("e")).alias("kind")).filter(F.col("kind").isin("secret", "email", "name"))
    words = found.select("kind", F.expr(r"""CASE WHEN kind = 'secret' THEN array(regexp_extract(e, r'^(.*?[=:]\s{0,3}["\x27]?)(.*)$', 2)) WHEN kind = 'email' THEN array(lower(e)) ELSE filter(split(e, '[ -]'), w -> NOT w RLIKE '[.]$') END""").alias("all"))
    titles = ALL_TITLES + [n for names in GIVEN.values() for n in names]
    parts = words.select("kind", F.explode("all").alias("e")).filter(~F.col("e").isin(titles)).distinct()
    widths: dict[str, int] = {}
    open_kinds = ["secret", "email", "name"]
    while open_kinds:
        w = {k: widths.get(k, DEFAULT_WIDTH) for k in open_kinds}
        drawn_of = {"secret": drawn("e", "'secret', e", key, str(w.get("secret"))), "email": email("e", key, str(w.get("email"))), "name": surname("e", key, str(w.get("name")))}
        cases = "CASE kind " + " ".join(f"WHEN '{k}' THEN {drawn_of[k]}" for k in open_kinds) + " END"
        both = parts.filter(F.col("kind").isin(open_kinds)).select("kind", "e", F.expr(cases).alias("s"))
        seen = both.select("kind", "s", F.lit(0).alias("own")).unionByName(both.select("kind", F.col("e").alias("s"), F.lit(1).alias("own")))
        clash = seen.groupBy("kind", "s").agg(F.sum(1 - F.col("own")).alias("drawn"), F.max("own").alias("own")).filter((F.col("drawn") > 1) | ((F.col("drawn") > 0) & (F.col("own") > 0)))
        open_kinds = [r["kind"] for r in clash.groupBy("kind").count().collect()]
        if stuck := [k for k in open_kinds if w[k] >= limit]:
            raise ValueError(f"surrogates of {', '.join(sorted(stuck))} still collide at width {limit}")
        widths |= w | {k: w[k] + 4 for k in open_kinds}
    return widths


def with_surrogates(docs: DataFrame, text_col: str = "text", key: str = KEY, widths: dict[str, int] | None = None) -> DataFrame:
    """Adds ``__new`` (the text with surrogates) and ``__kinds`` (types in order of place)."""
    forget_parses(docs.sparkSession)
    widths = collision_free_width(docs, text_col, key) if widths is None else widths
    text = f"`{text_col}`"
    found = docs.withColumn("__found", occurrences(text))
    replaced = f"transform(__found, e -> {surrogate('e', type_of('e'), key, widths)})"
    joined = f"array_join(zip_with(split({text}, {lit(ANY)}, -1), {replaced}, (a, b) -> concat(a, coalesce(b, ''))), '')"
    return found.withColumn("__new", F.expr(f"CASE WHEN size(__found) > 0 THEN {joined} ELSE {text} END")).withColumn("__kinds", F.expr(f"transform(__found, e -> {type_of('e')})"))


def replace(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = KEY) -> DataFrame:
    """(doc_id, text, n_entities, kinds): texts with surrogates; kinds are sorted and comma-joined."""
    out = with_surrogates(docs, text_col, key)
    return out.select(F.col(id_col).alias("doc_id"), F.col("__new").alias("text"), F.size("__found").cast("long").alias("n_entities"), F.array_join(F.array_sort(F.array_distinct("__kinds")), ",").alias("kinds"))


def replace_in_place(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", key: str = KEY) -> DataFrame:
    """The rows with surrogates in their text, and the count of code points to match."""
    out = with_surrogates(docs, text_col, key)
    new = {text_col: F.col("__new"), chars_col: F.coalesce(F.length("__new").cast(docs.schema[chars_col].dataType), F.col(chars_col))} if chars_col in docs.columns else {text_col: F.col("__new")}
    return out.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])
