"""Line-first cleaning, with built-in functions only.

Each line is judged by punctuation, navigation and boilerplate rules; lines that
fail are removed; documents that lose too much of their text go.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD

SYMBOLS = "#*$%&|<>"
#: Phrases that mark a line as boilerplate, in lower case.
BOILERPLATE = (
    "javascript", "cookie policy", "privacy policy", "terms of use", "all rights reserved", "lorem ipsum", "powered by",
    "datenschutzerklärung", "alle rechte vorbehalten", "nutzungsbedingungen", "tous droits réservés",
    "politique de confidentialité", "mentions légales", "todos los derechos reservados", "política de privacidad",
)
#: Words that part the entries of a menu or a path.
BARS = ("|", "›", "»", "•", "·")
#: What a link begins with.
LINKS = ("http://", "https://", "www.")
#: What a text with bars, links or a line cut off by an ellipsis holds.
OTHER = (*BARS[1:], "http", "www", "…", "...")
#: How a line of prose may end.
ENDS = ".!?:;,…\"'”»)]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _holds(text: Column, phrases: tuple[str, ...]) -> Column:
    """Whether any phrase is in the text; searches of bytes, a pattern of many branches takes several times as long."""
    return reduce(lambda x, y: x | y, (F.contains(text, F.lit(p)) for p in phrases))


def word_windows(words: Column) -> Column:
    """A 64-bit hash of each window of five words, made of the words' own hashes, so a word is read once."""

    def pairs(values: Column, others: Column, gap: int) -> Column:
        """Hashes of each value with the one ``gap`` places on."""
        n = F.greatest(F.size(others) - gap, F.lit(0))
        return F.zip_with(F.slice(values, 1, n), F.slice(others, 1 + gap, n), lambda x, y: F.xxhash64(x, y))

    def fives(hashes: Column) -> Column:
        fours = let(pairs(hashes, hashes, 1), lambda twos: pairs(twos, twos, 2))
        return let(fours, lambda x: pairs(x, hashes, 4))

    return let(F.transform(words, lambda w: F.xxhash64(w)), fives)


def repeated_words(windows: Column, n: int = 5) -> Column:
    """Words that lie in an n-word window found twice or more, all of them counted.

    Of the windows' hashes, (hash, place) are sorted, the places whose neighbour
    in that order has the same hash are taken, and what these windows cover is
    added up.  The work is n log n in the words of the text; each step is bound
    to a name, as it would be worked out anew wherever it is used.
    """

    def places(pairs: Column) -> Column:
        same = F.zip_with(pairs, F.slice(pairs, 2, F.size(pairs)), lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False)))
        met = let(same, lambda after: F.zip_with(after, F.concat(F.array(F.lit(False)), after), lambda x, y: x | y))
        return F.sort_array(F.filter(F.zip_with(pairs, met, lambda p, f: F.when(f, p["i"])), lambda x: x.isNotNull()))

    def covered(places: Column) -> Column:
        steps = F.zip_with(places, F.slice(places, 2, F.size(places)), lambda x, y: F.least(F.coalesce(y - x, F.lit(n)), F.lit(n)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(let(pairs, places), covered)


def clean_lines(
    docs: DataFrame,
    min_words: int = 10,
    max_repeat_percent: int = 20,
    max_lost_percent: int = 50,
    max_symbol_percent: int = 15,
    max_shout_percent: int = 50,
    max_bars_percent: int = 30,
    max_links_percent: int = 50,
    menu_chars: int = 30,
    menu_lines: int = 3,
) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: base counts, the cleaned text and the verdict.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, n_lines, n_bad_lines, cleaned, kept.  A line with a word fails
    by punctuation (symbols are too large a share of its characters, "!!" of its
    words, or it is cut off by an ellipsis), by navigation (bars between its words,
    links as a large share of them, or a menu: ``menu_lines`` or more lines in a row
    of at most ``menu_chars`` characters and no end mark) or by a boilerplate
    phrase.  A document
    stays if it passes the base rules and its failed lines hold at most
    ``max_lost_percent`` of its word characters.  A null or blank text has no
    words, so it fails; rows with equal or null ids are judged each on its own;
    columns other than the two are left out; no row gives no row.  No shuffle takes place.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("_text"))
    rows = rows.withColumn("_words", _words(F.col("_text")))
    lines = F.filter(F.split("_text", "\n", -1), lambda x: F.ltrim(x, F.lit(SPACE)) != "")
    # columns of their own, or they would be worked out wherever they are used
    rows = rows.withColumns({"_lower": F.lower("_text"), "_lines": lines})
    ended = F.array(*(F.lit(c) for c in ENDS))
    short = lambda x: let(F.rtrim(x, F.lit(SPACE)), lambda t: (F.length(t) <= menu_chars) & ~F.array_contains(ended, F.right(t, F.lit(1))))
    rows = rows.withColumns(
        {
            "_windows": word_windows(F.col("_words")),
            "_n_symbols": F.regexp_count("_text", F.lit(f"[{SYMBOLS}]")),
            "_shouts": F.contains("_text", F.lit("!!")),
            "_boiler": _holds(F.col("_lower"), BOILERPLATE),
            "_other": _holds(F.col("_text"), OTHER),
            "_short": F.transform("_lines", short),
        }
    )
    rows = rows.withColumn("_menu", F.size(F.filter("_short", lambda x: x)) >= menu_lines)
    # where menu_lines short lines in a row begin, and which lines lie in such a run
    starts = F.transform("_short", lambda _, i: (i + menu_lines <= F.size("_short")) & F.forall(F.slice("_short", i + 1, menu_lines), lambda x: x))
    inside = lambda starts: F.transform(starts, lambda _, i: F.exists(F.slice(starts, F.greatest(i + 2 - menu_lines, F.lit(1)), F.least(i + 1, F.lit(menu_lines))), lambda x: x))
    rows = rows.withColumn("_menu", F.when(F.col("_menu"), let(starts, inside)))

    def link(word: Column) -> Column:
        return F.startswith(word, F.lit(LINKS[0])) | F.startswith(word, F.lit(LINKS[1])) | F.startswith(word, F.lit(LINKS[2]))

    def bad(line: Column) -> Column:
        return let(
            _words(line),
            lambda words: let(
                F.length(F.array_join(words, "")),
                lambda chars: (F.regexp_count(line, F.lit(f"[{SYMBOLS}]")) * 100 > chars * max_symbol_percent)
                | (F.contains(line, F.lit("!!")) & (F.regexp_count(line, F.lit("!!")) * 100 > F.size(words) * max_shout_percent))
                | let(F.size(F.filter(words, lambda w: w.isin(*BARS))), lambda bars: (bars >= 2) & (bars * 100 > F.size(words) * max_bars_percent))
                | (F.col("_other") & F.rtrim(line, F.lit(SPACE)).rlike(r"(…|\.\.\.)$"))
                | (F.col("_other") & (F.size(F.filter(words, link)) * 100 > F.size(words) * max_links_percent))
                | (F.col("_boiler") & F.lower(line).rlike("|".join(BOILERPLATE))),
            ),
        )

    # a text without any of the signs has no line that could fail
    may_fail = (F.col("_n_symbols") > 0) | F.col("_shouts") | F.col("_boiler") | F.col("_other")
    in_menu = lambda i: F.coalesce(F.get("_menu", i), F.lit(False))
    good = F.when(may_fail, F.filter("_lines", lambda x, i: ~in_menu(i) & ~bad(x)))
    good = good.when(F.col("_menu").isNotNull(), F.filter("_lines", lambda _, i: ~in_menu(i)))
    rows = rows.withColumn("_good", good.otherwise(F.col("_lines")))
    size = F.size("_words").cast("long")
    repeats = F.when(
        F.size(F.array_distinct("_windows")) < F.size("_windows"), repeated_words(F.col("_windows"))
    ).otherwise(F.lit(0).cast("long"))
    rows = rows.select(
        "doc_id",
        size.alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.col("_n_symbols").cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeats.alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size("_good")).cast("long").alias("n_bad_lines"),
        F.array_join("_good", "\n").alias("cleaned"),
    )
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    left = F.when(F.col("n_bad_lines") == 0, F.col("word_chars")).otherwise(F.length(F.translate("cleaned", SPACE, "")))
    kept = ~F.col("base_failed") & ((F.col("word_chars") - left) * 100 <= F.col("word_chars") * max_lost_percent)
    rows = rows.withColumn("base_failed", failed)
    return rows.withColumn("kept", kept)
