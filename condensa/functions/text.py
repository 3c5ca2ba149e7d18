"""Text functions as column expressions, evaluated inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The built-in stop words; any list can be given instead.
STOP_WORDS = (
    "a an and are as at be but by can do for from had has have he her his i if in into is it its me my no not of on or our she so "
    "that the their them they this to was we were what when which who will with you your "
    "de der die das und ist im mit ein eine la le les des du et un une dans est que qui pour en el los las y se del al por con"
).split()
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: What white space is to the tokenizers.
SPACES = " \t\n\x0b\f\r"
#: Answers that say nothing.
BLANK_ANSWERS = ["?", "[blank]", "n/a", "blank"]


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is evaluated once, also where f uses it inside lambdas."""
    return F.transform(F.array(value), f)[0]


def tokens(text: Column) -> Column:
    """Lower-cased, split at white space; no lambda, so it stays in generated code."""
    bare = F.btrim(F.lower(text), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "\\s+"))


def wordpunct(text: Column) -> Column:
    """Runs of letters and digits, and runs of other visible characters."""
    return F.regexp_extract_all(text, F.lit("[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]+"), F.lit(0))


def tagged_tokens(text: Column) -> Column:
    """Lower-cased words, with markup tags kept whole."""
    return F.regexp_extract_all(F.lower(text), F.lit("<a.*?/a>|<[^>]*>|[\\p{L}\\p{N}_'@#]+"), F.lit(0))


def sentences(text: Column) -> Column:
    """Lines, cut again after . ? or ! before white space; blank ones dropped."""
    return F.filter(F.transform(F.split(F.regexp_replace(text, "([.?!])\\s+", "$1\n"), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def ngrams(toks: Column, n: int, joiner: str = " ") -> Column:
    """All runs of n tokens, in order."""

    def runs(t: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(t) - (n - 1))
        return F.when(F.size(t) >= n, F.transform(places, lambda i: F.array_join(F.slice(t, i, n), joiner))).otherwise(F.array().cast("array<string>"))

    return toks if n == 1 and joiner == " " else let(toks, runs)


def gram_array(toks: Column, n: int) -> Column:
    """All runs of n tokens, then n - 1 nulls: each a concatenation of neighbours, with no slice a run."""
    out = toks
    for i in range(1, n):
        out = F.zip_with(out, F.slice(toks, i + 1, F.size(toks)), lambda a, b: F.concat(a, F.lit(" "), b))
    return out


def bigram_pieces(text: Column) -> Column:
    """All runs of two tokens, then the last token alone (or an empty string): cut by one regular expression, with no lambda."""
    return F.split(F.regexp_replace(F.btrim(F.lower(text), F.lit(SPACES)), "\\s+(\\S+)", " $1\n$1"), "\n")


def stop_only(gram: Column, n: int, stop: list[str] = STOP_WORDS) -> Column:
    """Whether all n words of an n-gram are stop words."""
    if n == 2:
        return F.substring_index(gram, " ", 1).isin(*stop) & F.substring_index(gram, " ", -1).isin(*stop)
    w = F.split(gram, " ")
    out = F.lit(True)
    for i in range(n):
        out = out & F.get(w, F.lit(i)).isin(*stop)
    return out


def gram_rows(rows: DataFrame, keep: list, text: str = "text", n: int = 2, distinct: bool = False, stop: list[str] | None = STOP_WORDS, name: str = "concept") -> DataFrame:
    """keep, name: a row for each n-gram of a text, or each distinct one; those of stop words only are left out.

    Stop words are looked up on rows, in generated code, not in lambdas.
    """
    if n == 2 and distinct:
        cut = F.array_distinct(bigram_pieces(F.col(text)))
    elif n == 2:
        cut = tokens(F.col(text))
    else:
        grams = gram_array(tokens(F.col(text)), n)
        cut = F.array_distinct(grams) if distinct else grams
    once = rows.select(*keep, cut.alias("grams__"))  # what is kept is computed once a text, not once a row
    held = [F.col(f"`{c}`") for c in once.columns[:-1]]
    if n == 2 and not distinct:
        # the two words meet on a row, so they are looked up before they are joined
        pairs = once.select(*held, F.inline(F.arrays_zip(F.col("grams__").alias("a__"), F.slice("grams__", F.lit(2), F.size("grams__")).alias("b__"))).alias("a__", "b__")).where("b__ IS NOT NULL")
        pairs = pairs if stop is None else pairs.where(~(F.col("a__").isin(*stop) & F.col("b__").isin(*stop)))
        return pairs.select(*held, F.concat("a__", F.lit(" "), "b__").alias(name))
    out = once.select(*held, F.explode("grams__").alias(name)).where(F.instr(name, " ") > 0 if n == 2 else F.col(name).isNotNull())
    return out if stop is None else out.where(~stop_only(F.col(name), n, stop))


def is_stop(word: Column, stop: list[str] = STOP_WORDS) -> Column:
    return word.isin(*stop)


def drop_stop_ngrams(grams: Column, stop: list[str] = STOP_WORDS, joiner: str = " ") -> Column:
    """Without the n-grams that consist of stop words only."""
    return F.filter(grams, lambda g: ~F.forall(F.split(g, joiner), lambda w: w.isin(*stop)))


def drop_stop_tokens(toks: Column, stop: list[str] = STOP_WORDS) -> Column:
    """Without stop words and without tokens that are one punctuation mark."""
    marks = list(PUNCTUATION)
    return F.filter(toks, lambda w: ~F.lower(w).isin(*stop) & ~w.isin(*marks))


def tagged_ngrams(toks: Column, tags: Column, n: int) -> Column:
    """Structs of an n-gram and the n-gram of its tags."""
    return F.zip_with(ngrams(toks, n), ngrams(tags, n), lambda gram, tag: F.struct(gram.alias("gram"), tag.alias("tag")))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\\s+"), lambda x: x != ""))


def is_malformed(phrase: Column, stop: list[str] = STOP_WORDS) -> Column:
    """A single stop word or number, or a phrase that begins with punctuation."""
    single = word_count(phrase) == 1
    return (single & (F.lower(phrase).isin(*stop) | phrase.rlike("^[0-9]+$"))) | F.substring(phrase, 1, 1).isin(*list(PUNCTUATION))


def is_blank_answer(text: Column) -> Column:
    clean = F.lower(F.trim(text))
    return text.isNull() | clean.isin(*BLANK_ANSWERS) | (clean == "")


def fix_possessive(text: Column) -> Column:
    """Joins a separated 's to its word."""
    return F.replace(text, F.lit(" ' s"), F.lit(" 's"))


def normalize_response(text: Column, spelling: Column | None = None) -> Column:
    """Up to two leading and one trailing punctuation marks stripped, tokens set apart, spelling mapped (a map column)."""
    mark = "[\\p{Punct}]"
    clean = F.regexp_replace(F.regexp_replace(F.trim(text), f"^{mark}{{1,2}}", ""), f"{mark}$", "")
    toks = wordpunct(F.trim(clean))
    if spelling is not None:
        toks = F.transform(toks, lambda w: F.coalesce(F.element_at(spelling, F.lower(w)), w))
    return fix_possessive(F.array_join(toks, " "))


def normalize_reference(line: Column) -> Column:
    """Without a leading `n)` and a trailing `[n]`."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(line), "^[0-9]+\\)\\s*", ""), "\\s*\\[[0-9]+\\]$", ""))


def reference_weight(line: Column) -> Column:
    """The number in a trailing `[n]`, else 1."""
    return F.coalesce(F.regexp_extract(F.trim(line), "\\[(\\d{1,9})\\]$", 1).try_cast("int"), F.lit(1))


def strip_bracket_prefix(line: Column) -> Column:
    return F.regexp_replace(line, "^\\[[^\\]]*\\]\\s*", "")


def normalize_human(text: Column) -> Column:
    """One trailing punctuation mark dropped, tokens set apart, lower-cased."""
    return fix_possessive(F.lower(F.array_join(wordpunct(F.regexp_replace(F.trim(text), "[\\p{Punct}]$", "")), " ")))


def ascii_only(text: Column) -> Column:
    """Typographic quotes and dashes replaced, other characters beyond ASCII dropped."""
    plain = F.translate(text, "‘’“”–— ", "''\"\"-- ")
    return F.regexp_replace(plain, "[^\\x00-\\x7F]", "")


def mask_words(toks: Column, words: list[str], mask: str = "ddd") -> Column:
    return F.transform(toks, lambda w: F.when(w.isin(*words), F.lit(mask)).otherwise(w))


def overlap(a: Column, b: Column) -> Column:
    """How many items of a, repeats counted, are in b."""
    return F.size(F.filter(a, lambda w: F.array_contains(b, w)))


def share_outside(toks: Column, words: Column) -> Column:
    """The share of tokens that are not in a list; null without tokens."""
    return F.when(F.size(toks) > 0, 1 - overlap(toks, words) / F.size(toks))


def contains_ignoring_case(text: Column, part: Column) -> Column:
    return F.contains(F.lower(text), F.lower(part))


def skip_bigrams(toks: Column, gap: int = 4) -> Column:
    """Ordered pairs with at most `gap` tokens between, joined by a space."""

    def pairs(t: Column) -> Column:
        size, none = F.size(t), F.array().cast("array<string>")
        after = lambda i: F.transform(F.sequence(i + 1, F.least(size, i + gap + 1)), lambda j: F.concat_ws(" ", F.element_at(t, i), F.element_at(t, j)))
        return F.when(size > 1, F.flatten(F.transform(F.sequence(F.lit(1), size), lambda i: F.when(i < size, after(i)).otherwise(none)))).otherwise(none)

    return let(toks, pairs)


def surface_forms(toks: Column, stems: Column, n: int) -> Column:
    """A map from each n-gram of stems to the n-gram of tokens at its last place."""
    pairs = F.zip_with(ngrams(stems, n), ngrams(toks, n), lambda stem, form: F.struct(stem.alias("stem"), form.alias("form")))

    def last(p: Column) -> Column:
        return F.map_from_entries(F.filter(p, lambda x, i: ~F.exists(F.slice(p, i + 2, F.size(p)), lambda y: y["stem"] == x["stem"])))

    return let(pairs, last)


def plain_quotes(text: Column) -> Column:
    """Pairs of backticks or apostrophes, and typographic double quotes, as one kind of double quote."""
    return F.regexp_replace(text, "``|''|[\u201c\u201d\u201e]", '"')


def joined_paragraphs(text: Column) -> Column:
    """Of lines between <P> and </P> marks, one line a paragraph; lines outside of any are left out.  Marks count in either case."""
    found = F.regexp_extract_all(text, F.lit("(?is)<p>(.*?)</p>"), F.lit(1))
    return F.array_join(F.filter(F.transform(found, lambda x: F.trim(F.regexp_replace(x, "\\s+", " "))), lambda x: x != ""), "\n")


def lexicon_share(toks: Column, lexicon: Column) -> Column:
    """How many tokens a lexicon has, over the number of tokens and 0.00001."""
    return overlap(toks, lexicon) / (F.size(toks) + 1e-5)


def matching_name(key: Column, names: Column, start: str, end: str) -> Column:
    """The first of an array of file names that holds start, key and end in a row (parts of a regular expression); null if none."""
    return F.get(F.filter(names, lambda x: F.rlike(x, F.concat(F.lit(start), key.cast("string"), F.lit(end)))), F.lit(0))


def paragraphs(html: Column) -> Column:
    """Bodies of <p> elements in either case, tags stripped, white space collapsed."""
    found = F.regexp_extract_all(html, F.lit("(?is)<p(?:\\s[^>]*)?>(.*?)</p>"), F.lit(1))
    return F.transform(found, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), "\\s+", " ")))
