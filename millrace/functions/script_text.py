"""Column expressions that take SQL scripts apart.

Everything here is a built-in Spark expression over one row's text, so a
collection of scripts is processed where its rows lie, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_letters, digits

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted declaration syntax and the form of flow names. Java looks up letters that are listed in one
# table and tries ranges one by one.
NAME_PART = rf"(?:`[^`]+`|[{ascii_letters}_][{ascii_letters}{digits}_$]*)"
NAME = NAME_PART + r"(?:\s*\.\s*" + NAME_PART + r")*"
VIEW_HEAD = r"CREATE\s+(?:OR\s+REPLACE\s+)?(?:(M)ATERIALIZED|(T)EMP(?:ORARY)?)\s+VIEW\s+(" + NAME + r")\s+AS\s+"
INSERT_HEAD = r"INSERT\s+INTO\s+(?:TABLE\s+)?(" + NAME + r")\s+"
INSERT_QUERY = r"(?=SELECT\b)"
SET_CONF = r"(?is)^SET\s+([A-Za-z0-9._-]+)\s*=\s*(.*?)\s*$"
READ_WORDS = r"\b(?:FROM|JOIN)\s+"
FLOW_NAME_FORMAT = "sql_flow_%03d_%s"
FLOW_NAME_REPLACED = rf"[^{ascii_letters}{digits}_.-]"
# End of fixed values.

HEAD = f"(?is)^(?:{VIEW_HEAD}|{INSERT_HEAD}{INSERT_QUERY})"
WHOLE_HEAD = f"(?is)^(?:{VIEW_HEAD}|{INSERT_HEAD})$"
# The lookahead rejects most positions before the costlier word boundary is tested.
INPUT = f"(?is)(?=[FJ]){READ_WORDS}({NAME})"

# Quoted text runs to its closing quote, or to the end of the script if there
# is none. A doubled quote reads as two literals side by side, which is the
# same text. The possessive repeat keeps the matcher from recursing, so a
# literal of any length is fine.
QUOTED = r"""'[^']*'?|"[^"]*"?|`[^`]*`?"""
# Runs of other characters are matched as a whole, which is three times as fast
# as trying every position.
PLAIN = r"""[^-/'"`]+"""
COMMENT = r"--[^\n]*|/\*(?s:.*?)(?:\*/|\z)"
# A statement begins at its first character that is no blank, so blank ones are not found at all.
STATEMENT = r"""(?![\x00-\x20;])(?:[^;'"`]+|""" + QUOTED + r")++"
# A WITH list in front of a query, with parentheses up to four deep; deeper or open ones are not taken for a list.
_INSIDE = r"[^()]*+"
for _ in range(4):
    _INSIDE = r"(?:[^()]+|\(" + _INSIDE + r"\))*+"
DEFINITION = r"(" + NAME_PART + r")\s*+(?:\([^()]*\)\s*+)?AS\s*+\(\s*+((?:SELECT|WITH|VALUES|FROM|TABLE|\()" + _INSIDE + r")\)"
WITH_LIST = r"(?is)^WITH\s++(RECURSIVE\s++)?" + DEFINITION + r"(?:\s*+,\s*+" + DEFINITION + r")*+"

BLANKS = "".join(chr(code) for code in range(33))

SET = "set"
UNSUPPORTED = "unsupported"


def stripped(text: Column) -> Column:
    """Without blanks and control characters at both ends."""
    return F.btrim(text, F.lit(BLANKS))


def without_comments(text: Column) -> Column:
    """Drop ``--`` and ``/* */`` comments that do not lie inside quotes."""
    return F.regexp_replace(text, f"({PLAIN}|{QUOTED})|{COMMENT}", "$1")


def statements(text: Column) -> Column:
    """The statements of a script: cut at ``;`` outside quotes, blank ones dropped."""
    pieces = F.regexp_extract_all(without_comments(text), F.lit(STATEMENT), F.lit(0))
    return F.transform(pieces, lambda s: F.rtrim(s, F.lit(BLANKS)))


def normalised_name(name: Column) -> Column:
    """A name without blanks around its parts and without back-quotes around a part.

    Parts are what lies between dots, also inside back-quotes. Most names have
    neither and stay as they are after one look.
    """
    joined = F.regexp_replace(stripped(name), r"[\x00-\x20]*\.[\x00-\x20]*", ".")
    bare = F.regexp_replace(joined, r"(?<![^.])`([^.`]*)`(?![^.])", "$1")
    return F.when(name.rlike(r"[`\x00-\x20]"), bare).otherwise(name)


def resolved_name(name: Column, database: str | None = None) -> Column:
    """The form in which Spark compares names: lower case, with the default database."""
    lower = F.lower(name)
    if database is None:
        return lower
    return F.when(lower.contains("."), lower).otherwise(F.concat(F.lit(database.lower() + "."), lower))


def head(statement: Column) -> Column:
    """The part of a declaration before its query; empty for everything else."""
    return F.regexp_extract(statement, HEAD, 0)


def shape(head_of: Column) -> Column:
    """``M:name``, ``T:name`` or ``:name``: the letter of a view's kind, none for a table, and the dataset as written.

    Empty for an empty head. All that a head tells is read from it in one go.
    """
    return F.regexp_replace(head_of, WHOLE_HEAD, "$1$2:$3$4")


def kind(statement: Column, shape_of: Column) -> Column:
    """``set``, the kind of dataset the statement fills, or ``unsupported``."""
    letter = F.upper(F.substr(shape_of, F.lit(1), F.lit(1)))
    return (
        F.when(letter == "", F.when(statement.rlike(SET_CONF), SET).otherwise(UNSUPPORTED))
        .when(letter == "M", "materialized_view")
        .when(letter == "T", "temporary_view")
        .otherwise("table")
    )


def write_mode(shape_of: Column) -> Column:
    return F.when(shape_of.startswith(":"), "insert").when(shape_of != "", "save")


def target(shape_of: Column) -> Column:
    """The dataset a declaration fills, null for everything else."""
    return F.when(shape_of != "", normalised_name(F.substr(shape_of, F.position(F.lit(":"), shape_of) + 1)))


def body(statement: Column, head_of: Column) -> Column:
    """The query of a declaration, null for everything else."""
    return F.when(head_of != "", stripped(F.substr(statement, F.length(head_of) + 1)))


def without_literals(query: Column) -> Column:
    """String literals become a blank."""
    return F.when(query.contains("'"), F.regexp_replace(query, "'[^']*'?", " ")).otherwise(query)


def input_names(query: Column) -> Column:
    """Every name after ``FROM`` or ``JOIN`` outside string literals, once, in first-seen order.

    The names of common table expressions are among them; names joined by a
    comma are not.
    """
    return _read_names(without_literals(query))


def _read_names(masked: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(masked, F.lit(INPUT), F.lit(1)), normalised_name))


def _given(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` worked out once however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def outside_inputs(inputs: Column, query: Column) -> Column:
    """The inputs that the query does not define itself.

    A name of the ``WITH`` list in front of a query hides a dataset only after
    its own definition; within it, only in a recursive list. Where the text
    does not tell, the input stays: an input too many is at worst refused as a
    cycle, and one too few would read old data.
    """

    def defined(text: Column) -> Column:
        return _given(F.regexp_extract(text, f"(?is)^{DEFINITION}", 1), lambda name: F.lower(normalised_name(name)))

    def real(masked: Column, listed: Column, texts: Column, names: Column, recursive: Column) -> Column:
        def read_in(text: Column, position: Column) -> Column:
            hidden = F.slice(names, F.lit(1), position + recursive.cast("int"))
            return _given(hidden, lambda h: F.filter(_read_names(text), lambda name: ~F.array_contains(h, F.lower(name))))

        within = F.flatten(F.transform(texts, read_in))
        after = _read_names(F.substr(masked, F.length(listed) + 1))
        return F.concat(within, F.filter(after, lambda name: ~F.array_contains(names, F.lower(name))))

    def outside(masked: Column, listed: Column) -> Column:
        # A first definition may have the name RECURSIVE, which only the whole pattern tells.
        recursive = F.when(listed.rlike(r"(?i)^WITH\s++RECURSIVE"), F.regexp_extract(listed, WITH_LIST, 1) != "").otherwise(False)
        return _given(
            F.regexp_extract_all(listed, F.lit(f"(?is){DEFINITION}"), F.lit(0)),
            lambda texts: _given(
                F.transform(texts, defined),
                lambda names: _given(recursive, lambda r: F.array_intersect(inputs, real(masked, listed, texts, names, r))),
            ),
        )

    def parted(masked: Column) -> Column:
        listed = F.regexp_extract(masked, WITH_LIST, 0)
        return _given(listed, lambda found: F.when(found == "", inputs).otherwise(outside(masked, found)))

    # Most queries have no list, which their first letters tell.
    begins = F.lower(F.substr(query, F.lit(1), F.lit(4))) == "with"
    return F.when(begins, _given(without_literals(query), parted)).otherwise(inputs)


def setting(statement: Column) -> Column:
    """``(key, value)`` of a ``SET`` statement, one pair of quotes around the value removed."""
    value = stripped(F.regexp_extract(statement, SET_CONF, 2))
    return F.struct(
        F.regexp_extract(statement, SET_CONF, 1).alias("key"),
        F.regexp_replace(value, r"""(?s)^(['"])(.*)\1$""", "$2").alias("value"),
    )


def last_settings(settings: str) -> Column:
    """One entry per key of an array column, in the order of the keys; the last value of a key wins.

    Sorted by key and place, an entry is the last of its key if the next one has another.
    """
    placed = F.array_sort(
        F.transform(settings, lambda s, i: F.struct(s["key"].alias("key"), i.alias("i"), s["value"].alias("value")))
    )
    after = F.transform(F.slice(placed, F.lit(2), F.size(placed)), lambda s: s["key"])
    pairs = F.arrays_zip(placed.alias("own"), after.alias("next"))
    last = F.filter(pairs, lambda p: ~p["own"]["key"].eqNullSafe(p["next"]))
    return F.transform(last, lambda p: F.struct(p["own"]["key"].alias("key"), p["own"]["value"].alias("value")))


def flow_name(number: Column, target_name: Column) -> Column:
    """``FLOW_NAME_FORMAT``, without a formatter for numbers that need no zeros in front, which are most of many."""
    before, after = FLOW_NAME_FORMAT.split("%03d")
    padded = F.when(number >= 100, number.cast("string")).otherwise(F.format_string("%03d", number))
    safe = F.coalesce(F.regexp_replace(target_name, FLOW_NAME_REPLACED, "_"), F.lit("null"))
    return F.concat(F.lit(before), padded, F.lit(after.removesuffix("%s")), safe)
