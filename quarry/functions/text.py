"""Text functions as Column builders; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model: words without intent, phrases of acceptance and rejection, hints, extensions, citations.
FILLER = (
    "hi hey hello please pls thanks thank you could can would will kindly just now ok okay so well the a an to of for and is are do does i we me my our it this that how what why help"
).split()
ACCEPT = "thanks|thank you|works|worked|perfect|great|awesome|nice|that fixed|that did it|solved|resolved|exactly|brilliant"
REJECT = "no|nope|still|doesn'?t work|does not work|didn'?t work|not working|wrong|incorrect|error again|same error|broke|broken|failing|didn'?t help|that'?s not|not what"
SCOPED = "our|ours|my|mine|we|us|internal|this (?:project|repo|repository|codebase|file)"
SHARED = "standard|spec|specification|law|statute|regulation|reference|documentation|docs|general|convention|best practice|guideline|rfc"
MARKDOWN_FILES = "md mdx markdown".split()
CODE_FILES = "ts tsx js jsx mjs cjs py go rs java c h cpp hpp cc rb php swift kt scala sh bash zsh sql css scss vue svelte".split()
MARKDOWN_UNITS = "md mdx markdown rst txt adoc".split()
CODE_UNITS = "py js ts jsx tsx go rs java c h cpp hpp cs rb php swift kt scala lua sh css scss sql html vue svelte".split()
DEFINITION = (
    "(?m)^\\s*(?:export\\s+|public\\s+|private\\s+|protected\\s+|static\\s+|async\\s+|pub\\s+)*"
    "(def|function|func|fn|class|interface|type|enum|struct|trait|impl|const|let|var)(?![A-Za-z0-9_])\\s*([A-Za-z_$][A-Za-z0-9_$]*)?"
)
SYMBOLS = "def function func fn class struct impl trait".split()
URL = "https?://[^\\s)<>\\]\"']+"
CITATIONS = ["(?<![A-Za-z0-9_])[0-9]{1,5}/[0-9]{2,4}(?![A-Za-z0-9_])", "(?<![A-Za-z0-9_])[A-Z]{2,6}\\s?[0-9]+(?::[0-9]+(?:\\.[0-9]+)*)?(?![A-Za-z0-9_])", "§\\s?[0-9]+[a-z]?"]
MAX_URI = 2048


def _word_bound(pattern: str) -> str:
    """A pattern at ASCII word bounds, case-insensitive."""
    return f"(?i)(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"


def intent_terms(text: Column | str) -> Column:
    """Terms of an intent: code blanked out, lower case, ASCII words of two letters and more that aren't filler; null gives none."""
    bare = F.lower(F.regexp_replace(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")), "(?s)```.*?```|`[^`]*`", " "))
    return F.filter(F.regexp_extract_all(bare, F.lit("[a-z0-9]+"), F.lit(0)), lambda t: (F.length(t) > 1) & ~t.isin(FILLER))


def intent_key(normalized: Column) -> Column:
    return F.concat(F.lit("i"), F.substring(F.sha2(normalized, 256), 1, 30))


def oneline(text: Column, limit: int = 200) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "\\s+", " ")), 1, limit)


def token_estimate(text: Column) -> Column:
    """A token per four characters, rounded half up, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4 + 0.5)).cast("long")


def accepts(text: Column) -> Column:
    return F.coalesce(text.rlike(_word_bound(ACCEPT)), F.lit(False))


def rejects(text: Column) -> Column:
    return F.coalesce(text.rlike(_word_bound(REJECT)), F.lit(False))


def query_intent(text: Column) -> Column:
    """scoped, shared, or balanced if hints of both kinds or none are there."""
    own, common = (F.coalesce(text.rlike(_word_bound(p)), F.lit(False)) for p in (SCOPED, SHARED))
    return F.when(own & ~common, "scoped").when(common & ~own, "shared").otherwise("balanced")


def layer_weights(intent: Column) -> Column:
    """Weights of the project's own and of the shared layer."""
    own = F.when(intent == "scoped", 0.8).when(intent == "shared", 0.2).otherwise(0.5)
    return F.struct(own.alias("scoped"), F.round(1 - own, 6).alias("shared"))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "\\.([^./\\\\]*)\\z", 1))


def strategy(path: Column, configured: Column | None = None) -> Column:
    """markdown, code or text: as configured, else (auto or null) by the extension."""
    end = extension(path)
    auto = F.when(end.isin(MARKDOWN_FILES), "markdown").when(end.isin(CODE_FILES), "code").otherwise("text")
    return auto if configured is None else F.when(configured.isin("markdown", "code", "text"), configured).otherwise(auto)


def unit_type(text: Column, path: Column) -> Column:
    """section, symbol, definition, code or text."""
    end, body = extension(path), F.coalesce(text, F.lit(""))
    word = F.regexp_extract(body, DEFINITION, 1)
    return (
        F.when(end.isin(MARKDOWN_UNITS), F.when(body.rlike("(?m)^#{1,6}\\s"), "section").otherwise("text"))
        .when(end.isin(CODE_UNITS), F.when(word.isin(SYMBOLS), "symbol").when(word != "", "definition").otherwise("code"))
        .otherwise("text")
    )


def symbol_name(text: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), DEFINITION, 2), F.lit(""))


def references(text: Column) -> Column:
    """Array of (kind, uri): URLs, then each shape of citation, each once, in order; longer than 2048 and empty ones left out."""
    body = F.coalesce(text, F.lit(""))
    urls = F.transform(F.regexp_extract_all(body, F.lit(URL), F.lit(0)), lambda u: F.struct(F.lit("url").alias("kind"), F.trim(F.regexp_replace(u, "[.,);]+\\z", "")).alias("uri")))
    found = [F.transform(F.regexp_extract_all(body, F.lit(p), F.lit(0)), lambda c: F.struct(F.lit("citation").alias("kind"), F.trim(c).alias("uri"))) for p in CITATIONS]
    return F.array_distinct(F.filter(F.concat(urls, *found), lambda r: (r["uri"] != "") & (F.length(r["uri"]) <= MAX_URI)))


def claim_terms(text: Column) -> Column:
    """Distinct terms of a claim: digit groups joined by / : . - are one, else word runs."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[0-9]+(?:[/:.\\-][0-9]+)+|[A-Za-z0-9_]+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / F.size(F.array_union(a, b))).otherwise(0.0)


def half_up(x: Column, digits: int) -> Column:
    """Rounded with halves toward positive infinity."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def highlight(text: Column, query: str) -> Column:
    """Marks the query's words of two letters and more."""
    import re

    words = [re.escape(w) for w in query.split() if len(w) > 1]
    return F.regexp_replace(text, f"(?i)({'|'.join(words)})", "<mark>$1</mark>") if words else text


# Strings that name a module, in JavaScript and TypeScript, and in Go.
SCRIPT_FILES = "js jsx mjs cjs ts tsx mts cts".split()
SCRIPT_IMPORTS = [r"(?m)^[ \t]*(?:import|export)[^A-Za-z0-9_][^'\";]*?from[ \t]*['\"]([^'\"\n]+)['\"]", r"(?m)^[ \t]*import[ \t]*['\"]([^'\"\n]+)['\"]"]
GO_BLOCK, GO_IMPORT, GO_NAME = r"(?m)^import[ \t]*\(([^)]*)\)", r"(?m)^import[ \t]+(?:[A-Za-z0-9_.]+[ \t]+)?\"([^\"\n]+)\"", r"\"([^\"\n]+)\""


def imports(text: Column, path: Column) -> Column:
    """Distinct quoted modules that a source file imports, sorted; other languages, null texts and paths give none."""
    body, end = F.coalesce(text, F.lit("")), extension(path)
    find = lambda t, p: F.regexp_extract_all(t, F.lit(p), F.lit(1))
    script = F.concat(*[find(body, p) for p in SCRIPT_IMPORTS])
    go = F.concat(find(F.array_join(find(body, GO_BLOCK), "\n"), GO_NAME), find(body, GO_IMPORT))
    return F.array_sort(F.array_distinct(F.when(end.isin(SCRIPT_FILES), script).when(end == "go", go).otherwise(F.array().cast("array<string>"))))


def build_url(template: Column, path: Column) -> Column:
    """The path put at {path} of the template, or behind it; null without a template."""
    behind = F.concat(F.regexp_replace(template, "/\\z", ""), F.lit("/"), path)
    # only the first {path} is one
    at = F.instr(template, "{path}")
    inside = F.concat(F.substring(template, F.lit(1), at - 1), path, F.substring(template, at + 6, F.length(template)))
    return F.when(F.coalesce(template, F.lit("")) != "", F.when(at > 0, inside).otherwise(behind))


def descriptor(title: Column, snippet: Column) -> Column:
    """A short label: the title's last path part, or the snippet's first four words; at most 34 characters."""
    t = F.trim(F.coalesce(title, F.lit("")))
    t = F.when(t != "", t).otherwise(F.array_join(F.slice(F.split(F.coalesce(snippet, F.lit("")), "[ \\t\\r\\n]+"), 1, 4), " "))
    end = F.element_at(F.split(t, "/"), -1)
    t = F.when(end != "", end).otherwise(t)
    return F.when(F.length(t) > 34, F.concat(F.substring(t, 1, 33), F.lit("…"))).when(t != "", t).otherwise("·")


def hue(name: Column) -> Column:
    """A colour angle that depends on the name only; 0 for null and empty names."""
    codes = F.transform(F.split(F.coalesce(name, F.lit("")), ""), lambda c: F.ascii(c).cast("long"))
    return F.pmod(F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c, F.lit(1 << 32))), F.lit(360))


def relative_age(at: Column, now: Column) -> Column:
    """How long before now: seconds below 90, minutes, hours below a day and a half, days; empty if later or null."""
    d = (F.unix_micros(now) - F.unix_micros(at)) / 1_000_000
    said = lambda unit, mark: F.concat(F.floor(d / unit + 0.5).cast("string"), F.lit(mark))
    late = F.when(d < 90, said(1, "s")).when(d < 5400, said(60, "m")).when(d < 129600, said(3600, "h")).otherwise(said(86400, "d"))
    return F.when(d >= 0, late).otherwise("")


def annotate(text: Column, uris: Column, mark: str = " [unverified]") -> Column:
    """The text with the mark behind each occurrence of each of the uris; without uris the text as it is."""
    return F.aggregate(F.coalesce(uris, F.array().cast("array<string>")), text, lambda t, u: F.replace(t, u, F.concat(u, F.lit(mark))))
