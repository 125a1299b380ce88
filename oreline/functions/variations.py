"""Typing-error variations of terms: for driver-side terms as plain functions, for columns as expressions."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Keys next to each other on a keyboard, and look-alikes.
NEAR_KEYS = {
    "q": "12wsa", "w": "q3edsa", "e": "w34rds", "r": "e45tfd", "t": "r56ygf7", "y": "t67uhg", "u": "y78ijh", "i": "u89okj1l", "o": "i90plk", "p": "o0-l",
    "a": "qwsz4", "s": "aqwedxz5", "d": "swerfcx", "f": "dertgvc", "g": "frtyhvb6", "h": "gtyujnb", "j": "hyuikmn", "k": "juiolm", "l": "kiop.1i",
    "z": "asx2", "x": "zsdc", "c": "xdfv", "v": "cfgb", "b": "vghn8", "n": "bhjm", "m": "njk",
    "1": "2qli", "2": "13wq", "3": "24ew", "4": "35re", "5": "46trss", "6": "57yt", "7": "68uy", "8": "79iu", "9": "80oi", "0": "9-po",
}
# Characters of other scripts that look like these in domains.
LOOK_ALIKES = {
    "a": "аą", "c": "с", "d": "ԁ", "e": "е", "g": "ցǥ", "h": "һ", "i": "іӀìíĭį", "j": "јĵ", "k": "κķĸ", "l": "ľ", "n": "ոŋņ", "o": "оοօ", "p": "р", "q": "ԛ", "r": "ŗ", "s": "ѕş",
    "t": "τţť", "u": "υս", "v": "ѵνγ", "w": "ԝ", "x": "хχ", "y": "уγ", "1": "ı", "2": "շ", "3": "З", "4": "Ч", "6": "б",
}
#: Terms of more parts than this are not reordered.
MOST_PARTS = 5


def omissions(word: str) -> list[str]:
    return list(dict.fromkeys(word[:i] + word[i + 1 :] for i in range(len(word))))


def duplications(word: str) -> list[str]:
    return list(dict.fromkeys(word[:i] + c + word[i:] for i, c in enumerate(word) if c != "-"))


def swaps(word: str) -> list[str]:
    pairs = (word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1))
    return [x for x in dict.fromkeys(pairs) if x != word]


def delimiters(word: str) -> list[str]:
    return [word[:i] + "-" + word[i:] for i in range(1, len(word)) if "-" not in word[i - 1 : i + 1]]


def near_keys(word: str, look_alikes: bool = False) -> list[str]:
    found = (word[:i] + x + word[i + 1 :] for i, c in enumerate(word) for x in NEAR_KEYS.get(c, "") + (LOOK_ALIKES.get(c, "") if look_alikes else ""))
    return list(dict.fromkeys(found))


def reorders(word: str) -> list[str]:
    """The other orders of the parts between ``-``; none if there are more than ``MOST_PARTS`` non-empty ones."""
    parts = word.split("-")
    if len([p for p in parts if p]) > MOST_PARTS or len(parts) < 2:
        return []
    return [x for x in dict.fromkeys("-".join(p) for p in permutations(parts)) if x != word]


def word_variations(word: str, reorder: bool = False, look_alikes: bool = False) -> list[str]:
    """All variations of a normalised term, in the order in which they are tried; never empty or the term itself."""
    found = [*duplications(word), *omissions(word), *swaps(word), *(reorders(word) if reorder else []), *near_keys(word, look_alikes), *delimiters(word)]
    return [x for x in dict.fromkeys(found) if x and x != word]


# --- the same over a column: an array of strings -----------------------------------------------------


def _at(word: Column, make) -> Column:
    """``make(i)`` for each 1-based position of a word."""
    n = F.length(word)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), make)).otherwise(F.array().cast("array<string>"))


def _piece(word: Column, start: Column, length: Column) -> Column:
    return F.substr(word, start, F.greatest(length, F.lit(0)))


def _left(word: Column, i: Column) -> Column:  # before position i
    return _piece(word, F.lit(1), i - 1)


def _right(word: Column, i: Column) -> Column:  # from position i
    return F.substr(word, i)


def omissions_column(word: Column) -> Column:
    return F.array_distinct(_at(word, lambda i: F.concat(_left(word, i), _right(word, i + 1))))


def duplications_column(word: Column) -> Column:
    made = _at(word, lambda i: F.when(_piece(word, i, F.lit(1)) != "-", F.concat(_left(word, i), _piece(word, i, F.lit(1)), _right(word, i))))
    return F.array_distinct(F.filter(made, lambda x: x.isNotNull()))


def swaps_column(word: Column) -> Column:
    n = F.length(word)
    made = _at(word, lambda i: F.when(i < n, F.concat(_left(word, i), _piece(word, i + 1, F.lit(1)), _piece(word, i, F.lit(1)), _right(word, i + 2))))
    return F.array_distinct(F.filter(made, lambda x: x.isNotNull() & (x != word)))


def delimiters_column(word: Column) -> Column:
    made = _at(word, lambda i: F.when((i > 1) & ~F.contains(_piece(word, i - 1, F.lit(2)), F.lit("-")), F.concat(_left(word, i), F.lit("-"), _right(word, i))))
    return F.filter(made, lambda x: x.isNotNull())


def near_keys_column(word: Column, look_alikes: bool = False) -> Column:
    pairs = [F.lit(x) for c in NEAR_KEYS for x in (c, NEAR_KEYS[c] + (LOOK_ALIKES.get(c, "") if look_alikes else ""))]
    table = F.create_map(*pairs)
    near = lambda i: F.coalesce(F.element_at(table, _piece(word, i, F.lit(1))), F.lit(""))

    def of(i: Column) -> Column:
        keys = F.filter(F.split(near(i), ""), lambda k: k != "")
        return F.transform(keys, lambda k: F.concat(_left(word, i), k, _right(word, i + 1)))

    n = F.length(word)
    made = F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(1), n), of))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(made)


def reorders_column(word: Column) -> Column:
    """``reorders``: places of parts are put before each other until all are; at most ``MOST_PARTS`` non-empty parts."""
    parts = F.split(word, "-")
    n = F.size(parts)

    def longer(orders: Column, turn: Column) -> Column:
        left = lambda o: F.array_except(F.sequence(F.lit(1), n), o)
        each = F.flatten(F.transform(orders, lambda o: F.transform(left(o), lambda i: F.concat(o, F.array(i)))))
        return F.when(turn < n, each).otherwise(orders)

    few = (n > 1) & (F.size(F.filter(parts, lambda p: p != "")) <= MOST_PARTS)
    start = F.transform(F.sequence(F.lit(1), n), lambda i: F.array(i))
    orders = F.aggregate(F.sequence(F.lit(1), n), start, longer)
    made = F.transform(orders, lambda o: F.array_join(F.transform(o, lambda i: F.element_at(parts, i)), "-"))
    return F.when(few, F.array_distinct(F.filter(made, lambda x: x != word))).otherwise(F.array().cast("array<string>"))


def near_key_table(spark: SparkSession, look_alikes: bool = False):
    """``char``, ``replacement``: the substitutions as a relation."""
    rows = [(c, x) for c in NEAR_KEYS for x in dict.fromkeys(NEAR_KEYS[c] + (LOOK_ALIKES.get(c, "") if look_alikes else ""))]
    return spark.createDataFrame(rows, "char string, replacement string")
