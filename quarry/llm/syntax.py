"""p4: source files that do not parse in the language of their extension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import grammar
from quarry.llm.pairs import once
from quarry.llm.splitting import current_documents

OPEN, CLOSE = "([{", ")]}"
#: Tokens are about so many times the bytes of the texts they come from; files are spread over so many times the tasks of a shuffle.
SPREAD = 2
#: Bits of a cell: its character with the mark of a beginning group, its order among the cells of a token, its token's position.
CHAR, ORDER, PLACE = 8, 2, 30


def language_of(rel_path: Column | str) -> Column:
    """The language of a path's extension in any case; null for other and missing extensions."""
    end = F.lower(F.regexp_extract(rel_path, "\\.([A-Za-z]+)\\z", 1))
    out = F.lit(None).cast("string")
    for ext, language in grammar.EXTENSIONS.items():
        out = F.when(end == ext, language).otherwise(out)
    return out


def _table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A fixed table of the grammar, of a size that no data changes."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def tokens(files: DataFrame) -> DataFrame:
    """(id, lang, pos, code, line, indent, fin): the tokens of (id, lang, content) with their classes, comments left out.

    line marks line ends, of which indent is the width of the blanks that follow (Python). A first and a last token of
    class ^ and $ (N in Python, where lines are statements; fin marks the last) stand for the ends.
    """
    spark = files.sparkSession
    lang, content = F.col("lang"), F.concat(F.lit("\n"), F.col("content"))
    found = F.lit(None).cast("array<string>")
    for name, pattern in grammar.LEXERS.items():
        text = content if name == "py" else F.regexp_replace("content", "\\A\\x{FEFF}", "") if name not in ("json", "toml") else F.col("content")
        found = F.when(lang == name, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(found)
    bounded = F.concat(F.array(F.lit("^")), found, F.array(F.lit("$")))
    rows = once(files, "__all", bounded).select("id", "lang", (F.size("__all") - 1).alias("last"), F.posexplode("__all").alias("pos", "token"))
    t, edge = F.col("token"), (F.col("pos") == 0) | (F.col("pos") == F.col("last"))
    two = F.substring("token", 1, 2)
    script, hashed = lang.isin("js", "ts", "go"), lang.isin("py", "toml")
    comment = F.when(script, two.isin("//", "/*")).when(hashed, t.startswith("#") | (lang == "py") & t.startswith("\\")).when(lang == "sql", two.isin("--", "/*")).otherwise(False)
    rows = rows.where(edge | ~comment)
    words = [(x, w, code) for x, classes in grammar.CLASSES.items() for code, ws in classes.items() for w in ws.split()]
    known = _table(spark, words, "lang string, word string, word_code string")
    joined = rows.withColumn("word", F.when(lang == "sql", F.upper("token")).otherwise(t)).join(known, ["lang", "word"], "left")
    first = F.ascii("token")
    letter = first.between(97, 122) | first.between(65, 90) | first.isin(95, 36) | ((first > 127) | (first == 35)) & t.rlike("\\A#?[\\p{L}_$]")
    quoted = (F.length(t) >= 2) & F.right(t, F.lit(1)).isin('"', "'", "`")
    form = (
        F.when(first.isin(10, 13) & ~t.contains("/"), "N")
        .when(quoted, F.when((lang == "sql") & (first != 39), "n").otherwise("s"))
        .when(lang == "toml", F.when(t.rlike(grammar.TOML_VALUE), "v").when(t.rlike(grammar.TOML_KEY), "n").otherwise("!"))
        .when(lang.isin("js", "ts") & first.isin(47, 32, 9, 12, 10, 13) & t.rlike("\\A\\s*/"), F.when(t.rlike("/.+/[a-z]*\\z"), "s").otherwise("!"))
        .when(first.between(48, 57) | (first.isin(45, 46) & t.rlike("\\A-?\\.?\\d")), "0")
        .when((lang != "json") & letter, F.when((lang == "py") & t.contains("$"), "!").otherwise("n"))
        .otherwise("!")
    )
    ends = F.when(edge, F.when(lang == "py", "N").when(F.col("pos") == 0, "^").otherwise("$"))
    typed = once(joined, "code", F.coalesce(ends, F.col("word_code"), form))
    line = F.col("code") == "N"
    blanks = F.replace(F.regexp_replace("token", "\\A[\\s\\S]*[\\r\\n]", ""), F.lit("\t"), F.lit("        "))
    fin = (lang == "py") & (F.col("pos") > 0) & (F.col("pos") == F.col("last"))
    indent = F.when(line & (lang == "py"), F.when(edge, 0).otherwise(F.length(blanks))).otherwise(0)
    return typed.select("id", "lang", "pos", "code", line.alias("line"), indent.alias("indent"), fin.alias("fin"))


def permitted(spark: SparkSession) -> DataFrame:
    """(lang, before, code, ok, apart): neighbouring classes that the productions have, as they are and with a separator between.

    A fixed table of the grammar. `apart` is null where the language puts no separator; Python's lines are matched whole.
    """
    rows = []
    for lang in grammar.PRODUCTIONS:
        both = grammar.permissible(lang)
        sep = {"go": ";", "js": ";", "ts": ";", "toml": "N"}.get(lang)
        after, ahead = {b for a, b in both if a == sep}, {a for a, b in both if b == sep}
        every = {c for p in both for c in p}
        for a in every:
            for b in every:
                ok, apart = (a, b) in both, a in ahead and b in after
                if ok or apart:
                    rows.append((lang, a, b, ok, apart))
    return _table(spark, rows, "lang string, before string, code string, ok boolean, apart boolean")


def placed(found: DataFrame) -> DataFrame:
    """Tokens but for line ends, with depth and step of nesting, what stands before and between, and whether that pair is wrong.

    `sep` is what ends a line before the token: N (TOML; Python outside brackets), a semicolon where the language puts
    one, or null. Go puts one after a line's last token if that can end a statement, JavaScript where the tokens may not
    follow each other. A pair is wrong if no production has it: an anti-join, kept as a mark so that tokens are read once.
    """
    order = Window.partitionBy("id").orderBy("pos")
    lines = found.withColumns({"nl": F.coalesce(F.lag("line").over(order), F.lit(False)), "width": F.lag("indent").over(order)})
    rows = lines.where("not line or fin").withColumn("step", F.when(F.col("code").isin(*OPEN), 1).when(F.col("code").isin(*CLOSE), -1).otherwise(0))
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"depth": F.sum("step").over(running), "before": F.lag("code").over(order), "second": F.lag("code", 2).over(order)})
    rows = rows.join(permitted(found.sparkSession), ["lang", "before", "code"], "left")
    lang, ends, code, before = F.col("lang"), F.col("nl"), F.col("code"), F.col("before")
    outer, ok = F.col("depth") - F.col("step"), F.coalesce("ok", F.lit(False))
    put = lang.isin("js", "ts") & (ends | (code == "}") | (code == "$")) & (~ok | (ends & code.isin(*grammar.STARTERS) & before.isin(*"ns0)]}i")))
    sep = (
        F.when(lang == "toml", F.when(ends, "N"))
        .when(lang == "py", F.when((outer == 0) & (ends | F.col("fin")), "N"))
        .when((lang == "go") & (ends | (code == "$")), F.when(before.isin(*"n0sBRk)]}"), ";"))
        .when(put, F.when(~before.isin(*";{}^"), ";"))
    )
    rows = once(rows, "sep", sep)
    beside = F.when(F.col("sep").isNull(), ok).otherwise(F.coalesce("apart", F.lit(False)))
    skipped = before.isNull() | (lang == "py") & (F.col("fin") | F.col("sep").isNotNull())
    return rows.withColumns({"outer": outer, "wrong": ~skipped & ~beside})


def _cell(level: Column, order: int, code: Column, start: Column | bool) -> Column:
    """A class as a number that sorts by level, position and order; a beginning group has the eighth bit of its character."""
    begins = F.when(start, 128).otherwise(0) if isinstance(start, Column) else F.lit(128 if start else 0)
    place = F.shiftleft(F.shiftleft(level.cast("long"), PLACE) + F.col("pos"), ORDER) + order
    return F.shiftleft(place, CHAR) + F.ascii(code) + begins


def shapes(rows: DataFrame) -> DataFrame:
    """(id, lang, wrong, level, shape, indents): a file's classes as one string, bracket group after bracket group.

    Groups come by their level, each begun by its kind's mark; inner groups stand as their two brackets. Level 0 is the
    file, in Python its logical lines, each begun by a mark too, with their indents. A file is a row of the input, so no
    task holds more than a row's content.
    """
    code, before, lang = F.col("code"), F.col("before"), F.col("lang")
    block = before.isNull() | before.isin(*"^;{)}>EDTZ") | (F.col("sep") == ";")
    opened = (
        F.when(lang.isin("js", "ts") & (code == "{") & block, "b")
        .when((lang == "py") & (code == "(") & (F.col("second") == "D"), "p")
        .when((lang == "toml") & (code == "[") & (F.col("outer") == 0) & ((before == "^") | F.col("sep").isNotNull()), "H")
        .when((lang == "toml") & (code == "[") & (before == "[") & (F.col("outer") == 1) & F.col("sep").isNull(), "?")
        .otherwise(code)
    )
    opens, closes = code.isin(*OPEN), code.isin(*CLOSE)
    own = _cell(F.when(opens, F.col("outer")).otherwise(F.col("depth")), 2, code, False)
    edge = F.when(opens, _cell(F.col("depth"), 3, opened, True)).when(closes, _cell(F.col("depth") + 1, 1, code, False))
    line = (lang == "py") & (F.col("sep") == "N")
    between = F.when(F.col("sep").isNotNull(), _cell(F.col("outer"), 0, F.col("sep"), line))
    kept = rows.select(
        "id", "lang", "wrong", "depth", F.when((lang != "py") | (code != "N"), own).alias("own"), edge.alias("edge"), between.alias("between"),
        F.when(line, F.shiftleft(F.col("pos").cast("long"), 24) + F.least(F.coalesce("width", F.lit(0)), F.lit((1 << 24) - 1))).alias("indent"),
    )
    per = kept.groupBy("id", "lang").agg(
        F.max("wrong").alias("wrong"), F.min("depth").alias("level"), F.collect_list("own").alias("own"), F.collect_list("edge").alias("edge"),
        F.collect_list("between").alias("between"), F.collect_list("indent").alias("indents"),
    )
    text = F.array_join(F.transform(F.sort_array(F.concat("own", "edge", "between")), lambda x: F.char(x.bitwiseAND(F.lit(255)))), "")
    indents = F.transform(F.sort_array("indents"), lambda x: x.bitwiseAND(F.lit((1 << 24) - 1)))
    return per.select("id", "lang", "wrong", "level", text.alias("shape"), indents.alias("indents"))


def _let(value: Column, body) -> Column:
    """body(value), where value is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def indented(lines: Column) -> Column:
    """Whether the logical lines (indent, shape) of a Python file nest: blocks are indented, dedents meet an open level, clauses
    follow theirs. A fold over the lines with the open levels as its state."""
    follows = {"L": "IL", "E": "ILFWX", "X": "TX", "Y": "TXE"}
    waits = lambda heads: F.exists(heads, lambda h: h.isin("T", "@"))
    start = F.struct(F.lit(True).alias("ok"), F.lit(False).alias("due"), F.array(F.lit(0)).alias("at"), F.array(F.lit("")).alias("head"))

    def placed_at(acc: Column, r: Column, x: Column) -> Column:
        keep, kind = x["keep"], x["kind"]
        popped = F.slice(acc["head"], keep + 1, F.greatest(F.size(acc["head"]) - keep, F.lit(0)))
        level = F.when(acc["due"], r["indent"] > F.element_at(acc["at"], -1)).otherwise((F.get(acc["at"], keep - 1) == r["indent"]) & ~waits(popped))
        last = F.when(acc["due"], "").otherwise(F.get(acc["head"], keep - 1))
        joins = F.lit(False)
        for clause, heads in follows.items():
            joins = joins | ((kind == clause) & last.isin(*heads))
        joins = joins & ((kind != "E") | r["shape"].startswith("E:"))
        plain = (last != "T") & ((last != "@") | kind.isin("D", "C", "@"))
        head = F.when(kind.isin(*"ILEFWTXYDCw@"), kind).otherwise("P")
        kept = F.slice(acc["head"], 1, F.greatest(keep - 1, F.lit(0)))
        return F.struct(
            (acc["ok"] & level & F.when(kind.isin(*follows), joins).otherwise(plain)).alias("ok"),
            r["shape"].endswith(":").alias("due"),
            F.when(acc["due"], F.concat(acc["at"], F.array(r["indent"]))).otherwise(F.slice(acc["at"], 1, keep)).alias("at"),
            F.when(acc["due"], F.concat(acc["head"], F.array(head))).otherwise(F.concat(kept, F.array(head))).alias("head"),
        )

    def step(acc: Column, r: Column) -> Column:
        letter = lambda i: F.substring(r["shape"], i, 1)
        kind = F.when((letter(1) == "A") & (F.length(r["shape"]) > 1), letter(2)).otherwise(letter(1))
        keep = F.when(acc["due"], F.size(acc["at"])).otherwise(F.size(F.filter(acc["at"], lambda a: a <= r["indent"])))
        return F.when((r["shape"] == "") | ~acc["ok"], acc).otherwise(_let(F.struct(keep.alias("keep"), kind.alias("kind")), lambda x: placed_at(acc, r, x)))

    return F.aggregate(lines, start, step, lambda acc: acc["ok"] & ~acc["due"] & ~waits(acc["head"]))


def _taken_out(per: DataFrame, where: Column, pattern: str, put: str, sign: str) -> DataFrame:
    """Shapes with all matches replaced, innermost first: twice, and where more are nested, as often as the sign is there."""
    one = lambda s: F.regexp_replace(s, pattern, put)
    twice = once(per, "shape", F.when(where & F.col("shape").contains(sign), one(one(F.col("shape")))).otherwise(F.col("shape")))
    left = F.length("shape") - F.length(F.replace("shape", F.lit(sign), F.lit("")))
    deeper = F.aggregate(F.sequence(F.lit(1), left), F.col("shape"), lambda s, _: one(s))
    return once(twice, "shape", F.when(where & F.col("shape").contains(sign) & F.col("shape").rlike(pattern), deeper).otherwise(F.col("shape")))


def unparsable(files: DataFrame) -> DataFrame:
    """Ids of the files (id, lang, content) that do not parse; id must be unique, null contents and other languages are left out.

    Files are lexed into rows. Pairs of neighbouring tokens are held against those that the grammar permits; then bracket
    groups are reduced to strings of classes, by windows, and matched against the productions; Python's lines are also
    checked for indentation. Whether names are bound, and what a literal's text means, is not looked at. Files are spread
    by id before they are lexed, so tokens, windows and verdicts of a file stay in one task and only contents are moved.
    """
    spark = files.sparkSession
    known = files.where(F.col("lang").isin(*grammar.PRODUCTIONS) & F.col("content").isNotNull()).select("id", "lang", "content")
    spread = known.repartition(SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    per = shapes(placed(tokens(spread)))
    per = _taken_out(per, F.col("lang") == "ts", grammar.TYPE_ARGUMENTS, "", "<")
    for lang, pattern in grammar.REDUCED.items():
        per = _taken_out(per, F.col("lang") == lang, pattern, "o", "I" if lang == "py" else "?")
    shape = F.col("shape")
    whole = F.lit(False)
    for lang in grammar.PRODUCTIONS:
        whole = F.when(F.col("lang") == lang, shape.rlike(grammar.file_pattern(lang))).otherwise(whole)
    first = F.regexp_extract("shape", grammar.LINES, 0)
    parts = F.slice(F.split(first, grammar.LINE), 2, F.size("indents"))
    lines = F.transform(F.arrays_zip(F.col("indents").alias("indent"), parts.alias("shape")), lambda x: F.struct(x["indent"].cast("int").alias("indent"), F.coalesce(x["shape"], F.lit("")).alias("shape")))
    straight = F.when(F.col("lang") == "py", indented(lines)).otherwise(True)
    return per.where(F.col("wrong") | (F.col("level") < 0) | ~whole | ~straight).select("id")


def source_files(documents: DataFrame) -> DataFrame:
    """(id, project_id, source_id, lang, content) of the current documents with a known extension and a content."""
    now = current_documents(documents.where(language_of("rel_path").isNotNull())).withColumn("lang", language_of("rel_path"))
    return now.where("content is not null").select("id", "project_id", "source_id", "lang", "content")


def found(documents: DataFrame) -> DataFrame:
    """document_id of the current files that do not parse."""
    return unparsable(source_files(documents)).select(F.col("id").alias("document_id"))


def rates(documents: DataFrame) -> DataFrame:
    """(project_id, source_id, lang, files, invalid, rate) per repository and language."""
    files = source_files(documents)
    bad = unparsable(files).withColumn("bad", F.lit(1))
    per = files.select("id", "project_id", "source_id", "lang").join(bad, "id", "left").groupBy("project_id", "source_id", "lang")
    out = per.agg(F.count("*").alias("files"), F.coalesce(F.sum("bad"), F.lit(0)).alias("invalid"))
    return out.withColumn("rate", F.round(F.col("invalid") / F.col("files"), 6))
