"""Replacement of personal data by surrogates.

Entities are found by pattern and check digit: e-mail addresses, IPv4
addresses, payment card numbers (Luhn), long account numbers, phone numbers,
social security numbers, IBANs (mod 97) and persons (a title or a listed given
name, then capitalised names). An entity's canonical form (separators and case
left out) decides its surrogate, so all mentions of it, in any document and
format, get the same one (coreference).

Surrogates are keyed (BLAKE2b under a secret key) and keep the type: digits for
digits under the same check rule, letters of the same case and script, an
address of the same kind of range, a given name of the same gender and script
(the listed ones change places under the key, others become made-up ones), and each
mention's own separators and case. Collisions are checked over all distinct
entities: no two entities of a type share a surrogate and no surrogate is itself
an entity of the corpus; whoever loses draws again until nothing collides, from a
wider space after some attempts (longer names, mailboxes and domains, the next
private range), so distinct stays distinct. A type that is still not settled after
MOST_ROUNDS rounds is an error that names it.

Limits: a person without a title is found by a listed given name alone.

Defined results: a null text stays null and has no entities; an empty one stays
empty; texts are searched whole; rows that repeat get equal results; other
columns are ignored; an empty table gives an empty result. Of overlapping
finds, the one that starts first (then the longest) counts.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.llm.common import map_rows, slices, written

# fixed values: given names by script and gender, titles by gender
GIVEN = {
    ("latin", "f"): "Anna Emma Maria Laura Sophie Clara Julia Elena Alice Marta Ines Nora Mary Linda Susan Karen Camille Chloe Lucia Carmen".split(),
    ("latin", "m"): "James John Peter Paul Thomas David Hans Karl Pierre Louis Carlos Jose Miguel Lukas Felix Robert Henri Andre Pablo Martin".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Вера Юлия".split(),
    ("cyrillic", "m"): "Иван Пётр Сергей Андрей Дмитрий Алексей Николай Павел Михаил Олег".split(),
    ("greek", "f"): "Μαρία Ελένη Άννα Σοφία Κατερίνα Ιωάννα Χριστίνα Βασιλική".split(),
    ("greek", "m"): "Γιώργος Νίκος Κώστας Δημήτρης Γιάννης Παύλος Ανδρέας Πέτρος".split(),
}
TITLES = {"m": "Mr Herr Monsieur Señor Sr Don Г-н Κύριος".split(), "f": "Mrs Ms Miss Frau Madame Mme Mademoiselle Señora Sra Doña Г-жа Κυρία".split(), "": "Dr Prof".split()}
# fixed values: syllables of made-up surnames
SYLLABLES = {
    "latin": "ba den fel gor han kel lin mar nor pel ran sel tor var wen zel mon dra bri sta".split(),
    "cyrillic": "ба вел гор дан зар кол лин мар нов пет рад сем тар фед хар чер шан жук бел дол".split(),
    "greek": "βα γελ δον θαν καλ λιν μαρ νικ παπ ραν σελ ταν φιλ χαρ ψαρ ζην".split(),
}
NAMES_BY = {n: (s, g) for (s, g), names in GIVEN.items() for n in names}
CAPITALS = {n.upper(): n for n in NAMES_BY}
MOST_ROUNDS = 500

_title = "|".join(regex.escape(t) for ts in TITLES.values() for t in ts)
_given = "|".join(regex.escape(n) for n in NAMES_BY)
_capitals = "|".join(regex.escape(n) for n in CAPITALS)
PATTERNS = [
    ("EMAIL", regex.compile(r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,63}@(?:[\p{L}\p{N}](?:[\p{L}\p{N}-]{0,61}[\p{L}\p{N}])?\.)+\p{L}{2,24}(?![\p{L}\p{N}@])")),
    ("IP", regex.compile(r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\p{L}\p{N}]|\.\d)")),
    ("IBAN", regex.compile(r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])")),
    ("SSN", regex.compile(r"(?<![\p{L}\p{N}-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\p{L}\p{N}-])")),
    ("NUMBER", regex.compile(r"(?<![\p{L}\p{N}.,-])\d(?:[ -]?\d){12,18}(?![\p{L}\p{N}])")),
    ("PHONE", regex.compile(r"(?<![\p{L}\p{N}.,/-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\p{L}\p{N}])")),
    ("PERSON", regex.compile(rf"(?<!\p{{L}})(?:(?P<title>{_title})\.?\ )(?P<a>\p{{Lu}}[\p{{L}}'’-]+)(?:\ (?P<b>\p{{Lu}}[\p{{L}}'’-]+))?|(?<!\p{{L}})(?P<g>{_given})\ (?P<s>\p{{Lu}}\p{{Ll}}[\p{{L}}'’-]*)|(?<!\p{{L}})(?P<G>{_capitals})\ (?P<S>\p{{Lu}}[\p{{Lu}}'’-]+)(?!\p{{L}})")),
]
TITLE_GENDER = {t: g for g, ts in TITLES.items() for t in ts}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_ok(s: str) -> bool:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def script_of(s: str) -> str:
    for c in s:
        name = unicodedata.name(c, "")
        for script in ("CYRILLIC", "GREEK", "LATIN"):
            if name.startswith(script):
                return script.lower()
    return "latin"


def find(text: str | None) -> list[dict]:
    """start, end, kind, canonical, body of the entities of one text, without overlap."""
    got = []
    for kind, pattern in PATTERNS:
        if not text or kind == "EMAIL" and "@" not in text:
            continue
        for m in pattern.finditer(text):
            body, start, end, own = m.group(), m.start(), m.end(), kind
            if kind in ("NUMBER", "PHONE", "SSN"):
                canonical = "".join(c for c in body if c.isdigit())
                if kind == "NUMBER":
                    own = "CARD" if luhn(canonical) else "ACCOUNT"
                if kind == "PHONE" and not 9 <= len(canonical) <= 15:
                    continue
            elif kind == "IBAN":
                canonical = body.replace(" ", "")
                if not 15 <= len(canonical) <= 34 or not iban_ok(canonical):
                    continue
            elif kind == "PERSON":
                if m["title"]:
                    start = m.start("a")
                    given, last = (m["a"], m["b"]) if m["b"] else (None, m["a"])
                    gender = TITLE_GENDER[m["title"]] or NAMES_BY.get(CAPITALS.get((given or "").upper()), ("", ""))[1]
                else:
                    given, last = m["g"] or CAPITALS[m["G"]], m["s"] or m["S"]
                    gender = NAMES_BY[given][1]
                body = text[start:end]
                canonical = f"{gender}|{(given or '').lower()}|{last.lower()}"
            else:
                canonical = body.lower()
            got.append({"start": start, "end": end, "kind": own, "canonical": canonical, "body": body})
    got.sort(key=lambda x: (x["start"], -x["end"]))
    out, at = [], 0
    for x in got:
        if x["start"] >= at:
            out.append(x)
            at = x["end"]
    return out


class Keyed:
    """A stream of choices that the key, the entity and the attempt decide."""

    def __init__(self, key: bytes, *what: str) -> None:
        self.seed, self.n, self.left = (key, "\0".join(what).encode()), 0, b""

    def below(self, m: int) -> int:
        if len(self.left) < 8:
            self.left = hashlib.blake2b(self.seed[1] + self.n.to_bytes(4, "big"), key=self.seed[0]).digest()
            self.n += 1
        x, self.left = self.left[:8], self.left[8:]
        return int.from_bytes(x, "big") % m


_BASES = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}


def _letters(s: str, k: Keyed) -> str:
    """Letters for letters of the same script, digits for digits; the rest stays."""
    out = []
    for c in s:
        if c.isdigit():
            out.append(str(k.below(10)))
        elif c.isalpha():
            base = _BASES[script_of(c)]
            out.append(base[k.below(len(base))])
        else:
            out.append(c)
    return "".join(out)


def surrogate(kind: str, canonical: str, key: bytes, attempt: int) -> str:
    """The canonical surrogate of one entity."""
    k = Keyed(key, kind, canonical, str(attempt))
    digits = lambda n: "".join(str(k.below(10)) for _ in range(n))
    wider = attempt // 4  # more room after every fourth attempt
    if kind == "MAILBOX":  # of one domain: local@domain
        local, _, domain = canonical.partition("@")
        return f"{_letters(local + 'a' * wider, k)}@{domain}"
    if kind == "DOMAIN":
        *labels, last, top = ["", *canonical.split(".")]
        return ".".join([*(_letters(x, k) for x in labels if x), _letters(last + "a" * wider, k), top])
    if kind == "IP":
        a, b, *_ = map(int, canonical.split("."))
        tail = [str(k.below(254) + 1) for _ in range(3)]
        # a private range that is used up goes on in the next larger one
        if (a, b) == (192, 168) and wider < 2:
            return ".".join(["192.168", *tail[:2]])
        if (a, b) == (192, 168) and wider < 6 or a == 172 and 16 <= b < 32 and wider < 6:
            return ".".join(["172", str(16 + k.below(16)), *tail[:2]])
        if a == 127 and wider < 16:
            return ".".join(["127", *tail])
        if a in (10, 127) or (a, b) == (192, 168) or a == 172 and 16 <= b < 32:
            return ".".join(["10", *tail])
        public = [x for x in range(1, 224) if x not in (10, 127, 172, 192)]
        return ".".join([str(public[k.below(len(public))]), *tail])
    if kind in ("CARD", "ACCOUNT"):
        body = canonical[0] + digits(len(canonical) - 2)
        right = next(str(d) for d in range(10) if luhn(body + str(d)))
        return body + (right if kind == "CARD" else str((int(right) + 1 + k.below(9)) % 10))
    if kind == "SSN":
        return f"{k.below(665) + 1:03d}{k.below(99) + 1:02d}{k.below(9999) + 1:04d}"
    if kind == "PHONE":
        keep = 1 if len(canonical) <= 10 else len(canonical) - 9
        return canonical[:keep] + str(2 + k.below(8)) + digits(len(canonical) - keep - 1)
    if kind == "IBAN":
        body = "".join(str(k.below(10)) if c.isdigit() else chr(65 + k.below(26)) for c in canonical[4:])
        check = 98 - int("".join(str(int(c, 36)) for c in body + canonical[:2] + "00")) % 97
        return f"{canonical[:2]}{check:02d}{body}"
    if kind == "GIVEN":
        gender, given = canonical.split("|")
        script = script_of(given)
        if (known := NAMES_BY.get(CAPITALS.get(given.upper()))) is not None:
            ring = sorted((n.lower() for n in GIVEN[known]), key=lambda n: Keyed(key, "RING", *known, n).below(1 << 62))
            return f"{gender}|{ring[(ring.index(given) + 1) % len(ring)]}"
        made = _made(script, k, 2 + attempt // 2) + ({"latin": "a", "cyrillic": "а", "greek": "α"}[script] if gender == "f" else "")
        return f"{gender}|{made}"
    return _made(script_of(canonical), k, 2 + k.below(2) + attempt // 2)  # a surname; longer after some attempts


def _made(script: str, k: Keyed, n: int) -> str:
    return "".join(SYLLABLES[script][k.below(len(SYLLABLES[script]))] for _ in range(n))


def dressed(kind: str, body: str, own: str) -> str:
    """The canonical surrogate ``own`` in the format of the mention ``body``."""
    if kind == "PERSON":
        _, given, last = own.split("|")
        upper = body.isupper()
        return " ".join(x.upper() if upper else x.capitalize() for x in (given, last) if x)
    if kind in ("EMAIL", "IP"):
        return "".join(c.upper() if i < len(body) and body[i].isupper() else c for i, c in enumerate(own)) if kind == "EMAIL" else own
    left = iter(own)
    return "".join(next(left) if c.isalnum() else c for c in body)


def assigned(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, canonical) distinct -> surrogate, without collisions, for kinds without parts. Rounds go on while any are left."""

    def draw(df: DataFrame) -> DataFrame:
        def make():
            return lambda c: {**c, "surrogate": [surrogate(k, x, key, a) for k, x, a in zip(c["kind"], c["canonical"], c["attempt"], strict=True)]}
        return map_rows(df.select("kind", "canonical", "attempt"), make, "kind string, canonical string, attempt int, surrogate string")

    # listed given names change places among themselves: each is one of them, and no two become one
    listed = (F.col("kind") == "GIVEN") & F.substring_index("canonical", "|", -1).isin([n.lower() for n in NAMES_BY])
    real = entities.filter(~listed).select(F.col("kind"), F.col("canonical").alias("surrogate"))
    rounds = 0
    now = written(draw(entities.withColumn("attempt", F.lit(0))), "surrogates")
    while True:
        # of those with one surrogate, the smallest entity keeps it; none may be a real entity's own form
        low = now.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "canonical")).alias("first"), F.count(F.lit(1)).alias("n"))
        many = now.join(low.filter("n > 1"), ["kind", "surrogate"]).filter(F.col("canonical") != F.col("first.canonical")).select("kind", "canonical")
        lost = written(many.unionByName(now.join(real, ["kind", "surrogate"], "left_semi").select("kind", "canonical")).distinct(), "lost")
        if not lost.take(1):
            return now.select("kind", "canonical", "surrogate")
        rounds += 1
        if rounds > MOST_ROUNDS:
            raise RuntimeError(f"no distinct surrogates left for {sorted(r['kind'] for r in lost.select('kind').distinct().collect())}")
        again = draw(now.join(lost, ["kind", "canonical"], "left_semi").withColumn("attempt", F.col("attempt") + 1))
        now = written(now.join(lost, ["kind", "canonical"], "left_anti").unionByName(again), "surrogates")


def resolved(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, canonical) distinct -> surrogate; persons and addresses are put together from their parts' surrogates."""
    e = entities.withColumn("p", F.split("canonical", r"\|")).withColumn("domain", F.substring_index("canonical", "@", -1))
    person, mail = F.col("kind") == "PERSON", F.col("kind") == "EMAIL"
    given = F.concat_ws("|", F.col("p")[0], F.col("p")[1])
    kinds = F.array(F.when(person, F.struct(F.lit("SURNAME").alias("kind"), F.get("p", F.lit(2)).alias("canonical"))),
                    F.when(person & (F.get("p", F.lit(1)) != ""), F.struct(F.lit("GIVEN").alias("kind"), given.alias("canonical"))),
                    F.when(mail, F.struct(F.lit("DOMAIN").alias("kind"), F.col("domain").alias("canonical"))),
                    F.when(mail, F.struct(F.lit("MAILBOX").alias("kind"), F.col("canonical").alias("canonical"))),
                    F.when(~person & ~mail, F.struct(F.col("kind").alias("kind"), F.col("canonical").alias("canonical"))))
    parts = e.select(F.explode(F.array_compact(kinds)).alias("x")).select("x.*").distinct()
    own = written(assigned(parts, key), "parts")

    def of(kind: str, name: str) -> DataFrame:
        return own.filter(F.col("kind") == kind).select(F.col("canonical").alias(f"{name}_of"), F.col("surrogate").alias(name))

    people = e.filter(person).withColumn("given_of", given).withColumn("last_of", F.get("p", F.lit(2)))
    people = people.join(of("SURNAME", "last"), "last_of").join(of("GIVEN", "given"), "given_of", "left")
    people = people.select("kind", "canonical", F.concat_ws("|", F.col("p")[0], F.coalesce(F.substring_index("given", "|", -1), F.lit("")), "last").alias("surrogate"))
    mails = e.filter(mail).withColumn("new_domain_of", F.col("domain")).withColumn("box_of", F.col("canonical"))
    mails = mails.join(of("DOMAIN", "new_domain"), "new_domain_of").join(of("MAILBOX", "box"), "box_of")
    mails = mails.select("kind", "canonical", F.concat_ws("@", F.substring_index("box", "@", 1), "new_domain").alias("surrogate"))
    plain = own.filter(~F.col("kind").isin("SURNAME", "GIVEN", "DOMAIN", "MAILBOX"))
    return plain.unionByName(people).unionByName(mails)


SPANS = "array<struct<start:int,end:int,kind:string,canonical:string,body:string>>"


def replace(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, text (with surrogates), n_entities, spans (kind:start:end of the original)."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))

    def make():
        return lambda c: {"doc_id": c["doc_id"], "tie": c["tie"], "spans": [find(t) for t in c["text"]]}

    found = map_rows(d, make, f"doc_id long, tie long, spans {SPANS}").filter(F.size("spans") > 0)
    found = written(found.dropDuplicates(["doc_id", "tie"]), "entities")
    each = found.select("doc_id", "tie", F.explode("spans").alias("e")).select("doc_id", "tie", "e.*")
    given = resolved(each.select("kind", "canonical").distinct(), key)
    edits = each.join(given, ["kind", "canonical"]).groupBy("doc_id", "tie").agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "kind", "body", "surrogate"))).alias("edits"))
    key_of = F.struct(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), F.col("tie"))
    out = d.withColumn("k", key_of).join(edits.select(key_of.alias("k"), "edits"), "k", "left").select("doc_id", "text", "edits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts, counts, spans = [], [], []
                for text, own in zip(part.column("text").to_pylist(), part.column("edits").to_pylist(), strict=True):
                    pieces, at = [], 0
                    for e in own or ():
                        pieces += [text[at:e["start"]], dressed(e["kind"], e["body"], e["surrogate"])]
                        at = e["end"]
                    texts.append("".join([*pieces, text[at:]]) if own else text)
                    counts.append(len(own or ()))
                    spans.append(",".join(f"{e['kind']}:{e['start']}:{e['end']}" for e in own or ()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(spans, pa.string())],
                                                 names=["doc_id", "text", "n_entities", "spans"])

    return out.mapInArrow(run, "doc_id long, text string, n_entities long, spans string")
