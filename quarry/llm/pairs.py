"""p2: defective prompt and response pairs."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.skew import skew_join
from quarry.operators.snapshot import latest
from quarry.session import BROADCAST_ROWS, written

#: The store keeps so many characters of an answer; a longer answer ends there without being defective.
STORED = 600
#: A word tells languages apart by a share of at least TELLING.
TELLING = 0.6
#: Entries that a task keeps of the words of runs of characters before it starts anew, and bytes of texts (or of tokens, at eight each) that it counts at once; results are alike.
KEPT, PIECE = 200_000, 8_000_000
SHINGLE, CONTAINED = 5, 0.8

# What stands for no answer, names of languages, and how answers decline.
PLACEHOLDERS = [
    "", "n a", "na", "none", "null", "nil", "nan", "undefined", "empty", "blank", "void", "tbd", "no response", "no output", "no answer", "answer", "response", "output", "reply",
    "antwort", "keine antwort", "leer", "réponse", "aucune réponse", "pas de réponse", "vide", "respuesta", "sin respuesta", "vacío",
]
#: Spellings of a language's name that are more than its code.
NAMES = {"eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "english": "en", "englisch": "en", "german": "de", "deutsch": "de", "french": "fr", "français": "fr", "francais": "fr", "französisch": "fr", "spanish": "es", "español": "es", "espanol": "es", "spanisch": "es"}
ASKED = {
    "en": "in english|auf englisch|en anglais|en inglés",
    "de": "in german|auf deutsch|en allemand|en alemán",
    "fr": "in french|auf französisch|en français|en francés",
    "es": "in spanish|auf spanisch|en espagnol|en español|en castellano",
}
REFUSALS = [
    "I am not able to assist with this request", "I am unable to help with that", "I’m sorry, but I can’t help with that", "I cannot comply with that", "I won’t be doing this one",
    "I must respectfully pass on this request", "Sorry, no comment on that topic", "That falls outside what I’m allowed to do", "It would not be appropriate for me to answer this",
    "Unfortunately this is something I have to decline", "As a language model I don’t have access to your files, so I cannot do that", "I can’t do that",
    "Diese Anfrage muss ich leider ablehnen", "Tut mir leid, dabei kann ich nicht helfen", "Das darf ich nicht beantworten", "Dazu bin ich nicht in der Lage",
    "Désolé, je ne peux pas vous aider pour cela", "Je dois malheureusement refuser cette demande", "Il ne m’est pas permis de traiter ce sujet",
    "Je ne suis pas en mesure de répondre à cette question",
    "Lo siento, no puedo ayudar con eso", "Lamentablemente debo rechazar esta petición", "No estoy en condiciones de responder a esto", "No me está permitido tratar este tema",
]
COURTESIES = [
    "I hope you understand", "Is there something else you would like to know", "Thanks for the question about", "Please contact whoever runs", "I see that matters to you", "Sorry for the delay",
    "Gibt es sonst noch etwas", "Danke für die Frage zu", "Bitte wende dich an",
    "Autre chose", "Merci pour la question sur", "Merci de vous adresser à",
    "Algo más", "Gracias por la pregunta sobre", "Por favor, dirígete a",
]


def graded_pairs(resolutions: DataFrame, intents: DataFrame) -> DataFrame:
    """(resolution_id, question, answer) of the graded resolutions whose intent exists; repeated ids count once, the latest."""
    graded = resolutions.where("graded and id is not null and intent_id is not null")
    once = latest(graded, ["id"], "ts", [F.xxhash64("response_excerpt", "intent_id")])
    asked = latest(intents.where("id is not null"), ["id"], "last_seen", [F.xxhash64("intent_text")])
    left = once.select(F.col("id").alias("resolution_id"), "intent_id", F.col("response_excerpt").alias("answer"))
    return skew_join(left, asked.select(F.col("id").alias("intent_id"), F.col("intent_text").alias("question")), "intent_id").drop("intent_id")


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with the column computed once per row; a plain withColumn is repeated by the optimizer in each place that uses it."""
    return df.withColumn(name, F.explode(F.array(value)))


def _squashed(text: str) -> list[str]:
    """Words in lower case without anything but letters and digits."""
    return re.sub(r"[^\w\s]+|_+", "", text.lower()).split()


def _contained(a: list[str], q: list[str]) -> float:
    """Share of a's word shingles that q has; shingles of five words, or of all words of the shorter one if it has fewer."""
    width = min(len(a), len(q), SHINGLE)
    if not width:
        return 0.0
    own, other = ({tuple(x[i : i + width]) for i in range(len(x) - width + 1)} for x in (a, q))
    return len(own & other) / len(own)


def _common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a machine word of positions at a time."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & at.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _is_copy(answer: str, question: str) -> bool:
    """Whether the answer's shingles are in the question, and nearly all of it aligns, in order, with most of the question."""
    q = _squashed(question)
    for text in dict.fromkeys((answer, re.sub(r"\A\s*[>\"“«']*\s*[^\W\d_]+(?: [^\W\d_]+){0,2}\s?:\s", "", answer))):
        a = _squashed(text)
        times = max(1, round(len(a) / max(1, len(q))))  # the question may be given back more than once
        if _contained(a, q * times) < CONTAINED:
            continue
        if (n := _common(a, q * times)) >= 0.9 * len(a) and n >= 0.6 * len(q) * times:
            return True
    return False


def _plain(s: str) -> list[str]:
    s = unicodedata.normalize("NFKC", s).lower().replace("’", "'")
    return re.findall(r"[\w']+(?:[-/._]\w+)*", s)


class _Refusals:
    """Sentences aligned with templates by longest common subsequence; answers without a template's word pair are spared."""

    def __init__(self) -> None:
        self.no, self.polite = ([_plain(t) for t in of] for of in (REFUSALS, COURTESIES))
        self.cues = {p for t in self.no for p in zip(t, t[1:])}
        self.having: dict[int, dict[str, list[int]]] = {}  # by templates: the places of those with a word
        for templates in (self.no, self.polite):
            having = self.having[id(templates)] = {}
            for i, t in enumerate(templates):
                for w in set(t):
                    having.setdefault(w, []).append(i)

    def only(self, text: str) -> bool:
        """Whether every sentence aligns with a refusal or a courtesy, and one with a refusal."""
        declined = cued = False
        for p in re.split(r"(?<=[.!?…])\s+|\n+", text):
            if not (s := _plain(p)):
                continue
            if self._like(s, self.no, 0.6):
                declined = True
            elif not self._like(s, self.polite, 0.5):
                return False
            cued = cued or any(c in self.cues for c in zip(s, s[1:]))
        return declined and cued

    def _like(self, s: list[str], templates: list[list[str]], own: float) -> bool:
        """Only templates that have enough of the words are aligned."""
        having, met = self.having[id(templates)], Counter()
        for w in s:
            met.update(having.get(w, ()))
        enough = [(templates[i], least) for i, n in met.items() if n >= (least := max(0.75 * len(templates[i]), own * len(s)))]
        return any(_common(t, s) >= least for t, least in enough)


@F.pandas_udf(T.StringType())
def _judged(question: pd.Series, answer: pd.Series) -> pd.Series:
    """copy, refusal or null, of one pair each."""
    refusals = _Refusals()
    one = lambda q, a: "copy" if q and _is_copy(a, q) else "refusal" if refusals.only(a) else None
    return pd.Series([one(q, a) for q, a in zip(question, answer)], dtype=object)


def _may_copy(question: Column, answer: Column) -> Column:
    """Whether the longest common subsequence can reach nine tenths of the answer: a tenth of its words at most, and a label of three, may be foreign."""
    words = lambda t: F.split(F.trim(F.regexp_replace(F.lower(t), "[^\\p{L}\\p{N}\\s]+", "")), "\\s+")
    foreign = lambda w: F.size(F.array_except(w, words(question))) <= 0.1 * F.size(w) + F.when(answer.contains(":"), 3).otherwise(0)
    return F.coalesce(F.element_at(F.transform(F.array(words(answer)), foreign), 1), F.lit(False))


def _one_of(words: list[str]) -> str:
    """A regular expression of the words, their common beginnings written once, so that most texts are left at the first character."""
    heads: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        heads.setdefault(w[:1], []).append(w[1:])
    parts = [(re.escape(c) if c != " " else "[^\\p{L}\\p{N}_']+") + _one_of(rest) if c else "" for c, rest in sorted(heads.items(), reverse=True)]
    return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"


def _may_refuse(answer: Column) -> Column:
    """Whether the answer has two neighbouring words of a refusal's template (or characters whose compatible forms may be such)."""
    cues = _one_of([" ".join(c) for c in _Refusals().cues])
    text = F.replace(F.lower(answer), F.lit("’"), F.lit("'"))
    return text.rlike(f"(?:\\A|[^\\p{{L}}\\p{{N}}_'])(?:{cues})(?![\\p{{L}}\\p{{N}}_'])|[\\x{{FB00}}-\\x{{FB06}}\\x{{FF00}}-\\x{{FFEF}}]")


def language_code(lang: Column | str) -> Column:
    """Two letters of a label in any spelling (de, DE, de-AT, German); null for others."""
    said = F.lower(F.trim(lang if isinstance(lang, Column) else F.col(lang)))
    named = F.coalesce(*[F.when(said == n, c) for n, c in NAMES.items()])
    return F.coalesce(named, F.when(said.rlike("\\A[a-z]{2}(?:[-_].*)?\\z"), F.substring(said, 1, 2)))


def _spoken(text: Column) -> Column:
    """Words of a text in lower case, without code, quotations, paths, compounds and numbers."""
    bare = F.regexp_replace(F.lower(text), "(?s)(?=[`“«\"])(?:```.*?(?:```|\\z)|“[^”]*”|«[^»]*»|\"[^\"]*\")", " ")
    left_out = "(?<!\\S)[^\\s/_0-9]*+[/_0-9]\\S*+|(?<![\\p{L}\\p{N}])[\\p{L}\\p{N}]++-[\\p{L}\\p{N}]+"
    return F.array_remove(F.regexp_extract_all(bare, F.lit(left_out + "|(\\p{L}++)"), F.lit(1)), "")


#: In RE2's syntax, as Arrow takes it.
_QUOTED = "(?s)```.*?(?:```|\\z)|“[^”]*”|«[^»]*»|\"[^\"]*\""


class _Words(dict):
    """The words of a run of characters without blanks, as in _spoken; found once for each run."""

    def __missing__(self, run: str) -> tuple[str, ...]:
        words: tuple[str, ...] = ()
        if run.isascii() and not re.search("[/_0-9]", run):
            words = tuple(re.findall("[A-Za-z]+", re.sub("[A-Za-z]+-[A-Za-z]+", " ", run) if "-" in run else run))
        elif not re.search("[/_0-9]", run):
            kinds = "".join(c if c == "-" else unicodedata.category(c)[0] for c in run)
            kinds = re.sub("[LN]+-[LN]+", lambda m: " " * len(m[0]), kinds)
            words = tuple(run[m.start() : m.end()] for m in re.finditer("L+", kinds))
        self[run] = words
        return words


def _pieces(batch: pa.RecordBatch, sizes: pa.Array) -> Iterator[pa.RecordBatch]:
    """The batch cut where its rows' sizes exceed PIECE, so that what is made of a piece is bounded."""
    of = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False), dtype="int64") // PIECE
    at = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
    return (batch.slice(i, j - i) for i, j in zip(at, at[1:]) if j > i)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(l, word, n) of texts (l, text) in lower case: how many have the word; a pair (l, word) may come more than once."""
    words = _Words()
    for batch in batches:
        for piece in _pieces(batch, pc.binary_length(batch.column(1))):
            runs = pc.ascii_split_whitespace(pc.replace_substring_regex(piece.column(1), _QUOTED, " "))
            spelt, langs = runs.flatten().dictionary_encode(), piece.column(0).dictionary_encode()
            if len(words) > KEPT:
                words.clear()
            of = [words[run] for run in spelt.dictionary.to_pylist()]
            number: dict[str, int] = {}
            every = np.array([number.setdefault(w, len(number)) for own in of for w in own], "int64")
            if not number:
                continue
            size = np.array([len(own) for own in of], "int64")
            run, text = spelt.indices.to_numpy(), np.repeat(np.arange(len(runs)), runs.value_lengths().to_numpy())
            many = size[run]  # a run of several words is as many rows
            at = np.repeat((np.cumsum(size) - size)[run] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            told = np.sort(np.repeat(text, many) * len(number) + every[at])
            once_each = told[np.diff(told, prepend=-1) > 0]
            pairs, n = np.unique(langs.indices.to_numpy()[once_each // len(number)].astype("int64") * len(number) + once_each % len(number), return_counts=True)
            named = langs.dictionary.take(pa.array(pairs // len(number))), pa.array(list(number), pa.string()).take(pa.array(pairs % len(number)))
            yield pa.RecordBatch.from_arrays([*named, pa.array(n, pa.int64())], ["l", "word", "n"])


def profile(size: dict[str, int], counts: DataFrame, least: int = 5) -> tuple[list[str], DataFrame]:
    """(languages, (word, tells)) of so many texts a language and counts (l, word, n) of those with a word: what share of a word's use each language has, for the words that tell.

    Rates are per language, so that a frequent language does not own shared words. A language needs a hundredth of the
    texts. Labels may be wrong now and then.
    """
    langs = {x: n for x, n in sorted(size.items()) if n >= sum(size.values()) / 100}
    rates = counts.groupBy("word").agg(F.sum("n").alias("n"), *[(F.sum(F.when(F.col("l") == x, F.col("n")).otherwise(0)) / n).alias(f"r{i}") for i, (x, n) in enumerate(langs.items())])
    total = sum((F.col(f"r{i}") for i in range(len(langs))), F.lit(0.0))
    shares = F.array(*[F.col(f"r{i}") / F.nullif(total, F.lit(0.0)) for i in range(len(langs))]).cast("array<double>")
    telling = rates.where(F.col("n") >= least).withColumn("tells", shares).where(F.array_max("tells") >= TELLING)
    return list(langs), written(telling.select("word", "tells"), "profile")


def _scored(pairs: DataFrame, langs: list[str], known: DataFrame, **sides: Column) -> DataFrame:
    """(resolution_id, a column per side): by side's words, an array of (s, l), how much they speak each language."""
    every = None
    for side, words in sides.items():
        rows = pairs.select("resolution_id", F.lit(side).alias("side"), F.explode(words).alias("word"))
        every = rows if every is None else every.unionByName(rows)
    few = known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    met = every.join(F.broadcast(known), "word") if few else skew_join(every, known, "word")
    sums = [F.sum(F.when(F.col("side") == side, F.get("tells", F.lit(i))).otherwise(0.0)).alias(f"{side}{i}") for side in sides for i in range(len(langs))]
    per = met.groupBy("resolution_id").agg(*sums)
    scores = lambda p: F.array(*[F.struct(F.col(f"{p}{i}").alias("s"), F.lit(x).alias("l")) for i, x in enumerate(langs)])
    return per.select("resolution_id", *[scores(side).alias(side) for side in sides])


def other_language(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(resolution_id): pairs (resolution_id, asked, spoken, wanted) whose answer's words speak another language than the question's, or than the wanted one.

    Two profiles: one from all labelled texts (id, text, lang) tells the language of the pairs where it is plain; the
    other, from those and all pairs so told, knows the words of prompts and answers.
    """
    none = pairs.select("resolution_id").limit(0)
    known = texts.select(language_code("lang").alias("l"), "text").where("l is not null and text is not null")
    sizes = lambda df: Counter({r.l: r["count"] for r in df.groupBy("l").count().collect()})  # noqa: E731  # a row per language
    size = sizes(known)
    taught = written(known.select("l", F.lower("text")).mapInArrow(_counted, "l string, word string, n long").groupBy("l", "word").agg(F.sum("n").alias("n")), "words")
    langs, first = profile(size, taught)
    if not langs:
        return none
    words = F.concat(F.coalesce("asked", F.array().cast("array<string>")), F.coalesce("spoken", F.array().cast("array<string>")))
    top = F.sort_array("all", asc=False)
    told = _scored(pairs, langs, first, all=words).where(top[0]["s"] >= 2 * F.coalesce(F.get(top, F.lit(1))["s"], F.lit(0.0)) + 1)
    plain = written(told.select("resolution_id", top[0]["l"].alias("l")), "plain")
    said = pairs.select("resolution_id", F.array_distinct(words).alias("words")).join(plain, "resolution_id").select("l", F.explode("words").alias("word"))
    spoken_here, second = profile(size + sizes(plain), said.groupBy("l", "word").agg(F.count("*").alias("n")).unionByName(taught))
    if not spoken_here:
        return none
    per = _scored(pairs, spoken_here, second, q=F.col("asked"), a=F.col("spoken")).join(pairs.select("resolution_id", "wanted"), "resolution_id")
    asked, spoken = F.array_max("q"), F.array_max("a")
    wanted = F.coalesce("wanted", F.when(asked["s"] > 0, asked["l"]))
    of = F.coalesce(F.array_max(F.filter("a", lambda x: x["l"] == wanted))["s"], F.lit(0.0))
    return per.where(wanted.isNotNull() & (spoken["l"] != wanted) & (spoken["s"] >= 2 * of + 0.9)).select("resolution_id")


def _tokens(text: Column) -> Column:
    """Words, P for a path or name with - _ / or digits inside, N for a number, ends of sentences as '.', other marks as they are."""
    text = F.regexp_replace(F.lower(text), "(?<![\\p{L}\\p{N}])[\\p{L}\\p{N}]++(?:[-_/][\\p{L}\\p{N}]++)++(?:\\.[a-z]\\w{0,4}(?!\\w))?", "\\u0001")
    text = F.regexp_replace(F.regexp_replace(text, "\\p{N}+", "\\u0002"), "[.!?…]+", ".")
    return F.regexp_extract_all(text, F.lit("[\\u0001\\u0002.,;:]|[\\p{L}\\p{M}]+(?:[’'][\\p{L}\\p{M}]+)*"), F.lit(0))


def _contexts(tokens: str, i: Column) -> Column:
    """What is known of the token at i: itself, the pair it ends, and the pair two before it (as 3 if there is none in its sentence)."""
    at = lambda k: F.coalesce(F.get(F.col(tokens), i - k), F.lit("^"))
    before = F.when(at(1).isin("^", ".") | at(2).isin("^", "."), "3").otherwise(F.concat_ws(" ", F.lit("3"), at(3), at(2)))
    return F.array(F.concat(F.lit("1 "), at(0)), F.concat_ws(" ", F.lit("2"), at(1), at(0)), before)


def _opened(answer: Column) -> Column:
    """Whether a code block, quotation or bracket stays open, or the last character opens something."""
    whole = F.when(answer.contains("```"), F.regexp_replace(answer, "(?s)```.*?```", " ")).otherwise(answer)
    end = "(?U)(?:\\s|\\p{So}|\\p{Cf}|\\(“[^”]*”\\))+\\z"
    bare = F.when(F.right(whole, F.lit(1)).rlike("[A-Za-z0-9.!?,;:]"), whole).otherwise(F.regexp_replace(whole, end, ""))

    def says(t: Column) -> Column:
        count = lambda c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
        more = lambda c, end: t.contains(c) & (count(c) > count(end))
        return (
            t.contains("```") | more("“", "”") | more("(", ")") | more("[", "]") | more("«", "»") | t.contains('"') & (count('"') % 2 == 1)
            | F.right(t, F.lit(1)).isin(*",;:([{<“«–-") & t.contains(" ")
        )

    return F.element_at(F.transform(F.array(bare), says), 1)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(c, seen, ends) of answers' tokens (k): how often each of a token's _contexts comes, and with an end of a sentence after it; a context may come more than once."""
    for batch in batches:
        for piece in _pieces(batch, pc.multiply(pc.list_value_length(batch.column(0)).cast("int64"), 8)):
            spelt = pc.drop_null(piece.column(0)).flatten().dictionary_encode()
            n = pc.list_value_length(piece.column(0)).drop_null().to_numpy().astype("int64")
            words = [*spelt.dictionary.to_pylist(), "^"]
            k, width = spelt.indices.to_numpy().astype("int64"), len(words)
            mark = np.array([w in {".", ",", ";", ":"} for w in words])
            stop = np.array([w in {".", "^"} for w in words])
            place = np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
            before = lambda j: np.where(place >= j, np.concatenate([np.full(min(j, len(k)), width - 1), k[: max(0, len(k) - j)]]), width - 1)
            kept = (place < np.repeat(n, n) - 1) & ~mark[k]
            ended = np.append(np.array([w == "." for w in words])[k[1:]], False)[kept].astype("int64")
            w0, w1, w2, w3 = k[kept], before(1)[kept], before(2)[kept], before(3)[kept]
            for spell, of in (
                (lambda x: f"1 {words[x]}", w0), (lambda x: f"2 {words[x // width]} {words[x % width]}", w1 * width + w0),
                (lambda x: "3" if x < 0 else f"3 {words[x // width]} {words[x % width]}", np.where(stop[w1] | stop[w2], -1, w3 * width + w2)),
            ):
                told = np.sort(of * 2 + ended)
                first = np.flatnonzero(np.diff(told >> 1, prepend=-9) != 0)
                seen = np.diff(np.append(first, len(told)))
                ends = np.add.reduceat(told & 1, first) if len(first) else seen
                yield pa.RecordBatch.from_arrays([pa.array([spell(x) for x in (told[first] >> 1).tolist()], pa.string()), pa.array(seen, pa.int64()), pa.array(ends, pa.int64())], ["c", "seen", "ends"])


def broken_off(answers: DataFrame) -> DataFrame:
    """(resolution_id): answers (resolution_id, open, stored, k) that stop before they are complete; k are their tokens.

    Those with plain signs are open. Else the last word decides, by how often its contexts end a sentence in all
    answers: a context that hardly ever does, or a word that nowhere ends one, says that the answer broke off. An answer's
    own end is not counted where it lacks a mark. Answers cut by the store count as contexts only.
    """
    stats = answers.where(F.size("k") > 1).select("k").mapInArrow(_ends, "c string, seen long, ends long").groupBy("c").agg(F.sum("seen").alias("seen"), F.sum("ends").alias("ends"))
    rows = answers.where("not stored").withColumn("n", F.size("k"))
    ended = F.get("k", F.col("n") - 1) == "."
    last = rows.where("not open and n > 0").select("resolution_id", ended.cast("int").alias("ended"), F.explode(_contexts("k", F.col("n") - 1 - ended.cast("int"))).alias("c"))
    joined = skew_join(last, stats, "c", "left")
    seen, ends = F.coalesce("seen", F.lit(0)) - F.col("ended"), F.coalesce("ends", F.lit(0)) - F.col("ended")
    of = lambda kind, v: F.max(F.when(F.col("c").startswith(kind), v))
    per = joined.groupBy("resolution_id", "ended").agg(*[of(f"{k} ", v).alias(f"{n}{k}") for k in (1, 2, 3) for n, v in (("s", seen), ("e", ends))])
    rare = lambda k, least: (F.col(f"s{k}") >= least) & (F.col(f"e{k}") < 0.03 * F.col(f"s{k}"))
    known = (F.col("s2") >= 3) | (F.col("s3") >= 3)
    stopped = F.when(F.col("ended") == 1, rare(2, 20) | rare(3, 20)).otherwise(
        rare(2, 3) | rare(3, 3) | (F.col("s1") < 2) | rare(1, 2) | (~known & (F.col("e1") < 0.1 * F.col("s1")))
    )
    return rows.where("open").select("resolution_id").unionByName(per.where(stopped).select("resolution_id"))


def _empty(answer: Column) -> Column:
    """Whether it is null, blank or a placeholder. One with more characters than any placeholder is none; it is read no further."""
    skipped, most = "\\p{P}\\p{Z}\\p{C}\\p{Sm}\\p{Sk}\\s", max(len(p.replace(" ", "")) for p in PLACEHOLDERS)
    left = F.trim(F.regexp_replace(F.lower(answer), f"[{skipped}]+", " "))
    return F.when(answer.rlike(f"\\A(?:[{skipped}]*+[^{skipped}]){{{most + 1}}}"), False).otherwise(F.coalesce(left.isin(PLACEHOLDERS), F.lit(True)))


def _wanted(question: Column) -> Column:
    """The language that the question asks for by name."""
    low = F.lower(question)
    named = F.coalesce(*[F.when(low.rlike(rf"(?U)\b(?:{p})\b"), x) for x, p in ASKED.items()])
    return F.when(low.rlike(_one_of("|".join(ASKED.values()).split("|"))), named)


def defects(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(resolution_id, defect) of the defective pairs of (resolution_id, question, answer); each has one defect.

    In this order: empty (null, blank or a placeholder), copy (by shingle containment, then by longest common
    subsequence), refusal (every sentence aligned with a refusal or courtesy), other_language (words of another language
    than the question's, or than the one asked for, by profiles learned from the labelled texts (id, text, lang)),
    truncated. A null question makes neither copy nor other_language; without labelled texts nor does any.
    resolution_id must be unique; other columns are left out. Texts are taken apart once and written; only pairs that may
    be copies or refusals by their words go through Python.
    """
    q, a = F.col("question"), F.coalesce("answer", F.lit(""))
    empty = F.col("empty")
    rest = F.when(q.isNotNull() & (q != ""), F.replace(a, q, F.lit(" "))).otherwise(a)
    said = F.regexp_replace(a, "(?s)(?=[`(])(?:```.*?(?:```|\\z)|\\(“[^”]*”\\))", " ")
    parts = F.struct(
        (~empty & (_may_copy(q, a) | _may_refuse(a))).alias("maybe"), _opened(a).alias("open"), (F.length(a) == STORED).alias("stored"),
        F.when(~empty, _tokens(said)).alias("k"), _wanted(q).alias("wanted"), F.when(~empty & q.isNotNull(), _spoken(q)).alias("asked"), F.when(~empty & q.isNotNull(), _spoken(rest)).alias("spoken"),
    )
    told_empty = once(pairs.select("resolution_id", "question", "answer"), "empty", _empty(F.col("answer")))
    taken = once(told_empty, "x", parts).select("resolution_id", "question", "answer", "empty", "x.*")
    taken = written(taken.withColumns({c: F.when(F.col("maybe"), F.col(c)) for c in ("question", "answer")}), "pairs")  # read by each test
    full = taken.where("not empty")
    judged = full.where("maybe").select("resolution_id", _judged("question", "answer").alias("defect")).where("defect is not null")
    told = lambda df, rank, defect: df.select("resolution_id", F.lit(rank).alias("rank"), F.lit(defect).alias("defect"))
    every = [
        told(taken.where("empty"), 0, "empty"), judged.select("resolution_id", F.when(F.col("defect") == "copy", 1).otherwise(2).alias("rank"), "defect"),
        told(other_language(full, texts), 3, "other_language"), told(broken_off(full), 4, "truncated"),
    ]
    out = every[0]
    for df in every[1:]:
        out = out.unionByName(df)
    return out.groupBy("resolution_id").agg(F.min_by("defect", "rank").alias("defect"))


def found(resolutions: DataFrame, intents: DataFrame, documents: DataFrame) -> DataFrame:
    """(resolution_id, defect): one row per defective graded pair; the documents with their languages teach the profiles."""
    return defects(graded_pairs(resolutions, intents), documents.select(F.col("doc_id").alias("id"), "text", "lang"))
