"""Submission ledgers as folds of their events, and official test commands as argument lists.

What an event does to a submission depends only on its state, so a run of events is a table that gives, for every state it may
begin in, how it ends. Such tables are made for blocks of an id's events side by side and then put one after another, so that
an id with any number of events is never one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.operators.selection import with_rank

STATES = ("new", "submitted", "completed", "failed", "cancelled", "promoted")

#: What an action makes of each state, in the order of STATES; None is no legal transition. Submitting what is open, done or
#: promoted leaves it; a result that comes again changes nothing.
TRANSITIONS = {
    "submit": ("submitted", "submitted", "completed", "submitted", "submitted", "promoted"),
    "complete": (None, "completed", "completed", None, None, None),
    "fail": (None, "failed", None, None, None, None),
    "cancel": (None, "cancelled", None, None, None, None),
    "promote": ("promoted", None, "promoted", None, None, "promoted"),
}

#: Events of an id in a block.
BLOCK = 4096


def _next(action: Column, state: Column) -> Column:
    """The number of the state after an action, or -1; an unknown action is never legal."""
    table = F.create_map(*(x for a, row in TRANSITIONS.items() for x in (F.lit(a), F.array(*(F.lit(-1 if s is None else STATES.index(s)) for s in row)))))
    return F.coalesce(F.try_element_at(table, action)[state], F.lit(-1))


def replayed(events: DataFrame, ident: str, order: list[str], action: str, call: str, block: int = BLOCK) -> DataFrame:
    """(ident, state, call, rejected): each id after its events in order.

    rejected counts the events that were not legal in the state they met, which change nothing. call is that of the last
    submission that opened the id anew. An id without a legal event is new. Rows without ident are left out.
    """
    ranked = with_rank(events.filter(F.col(ident).isNotNull()).select(ident, *order, F.col(action).alias("_a"), F.col(call).cast("string").alias("_c")), [ident], order)
    rows = F.array_sort(F.collect_list(F.struct("rank", F.col("_a").alias("a"), F.col("_c").alias("c"))))
    blocks = ranked.groupBy(ident, F.floor(F.col("rank") / block).alias("_b")).agg(rows.alias("e"))
    as_state = lambda n, c, r: F.struct(n.alias("s"), c.alias("c"), r.alias("r"))
    start = F.array(*(as_state(F.lit(i), F.lit(None).cast("string"), F.lit(0).cast("long")) for i in range(len(STATES))))
    opened = STATES.index("submitted")

    def step(table: Column, e: Column) -> Column:
        def moved(x: Column) -> Column:
            to = _next(e["a"], x["s"])
            opens = (e["a"] == "submit") & (to == opened) & (x["s"] != opened)
            return as_state(F.when(to < 0, x["s"]).otherwise(to), F.when(opens, e["c"]).otherwise(x["c"]), x["r"] + F.when(to < 0, 1).otherwise(0))

        return F.transform(table, moved)

    tables = blocks.select(ident, "_b", F.aggregate("e", start, step).alias("t"))
    put = tables.groupBy(ident).agg(F.array_sort(F.collect_list(F.struct("_b", "t"))).alias("bs"))

    def after(x: Column, b: Column) -> Column:
        y = b["t"][x["s"]]
        return as_state(y["s"], F.coalesce(y["c"], x["c"]), x["r"] + y["r"])

    last = F.aggregate("bs", as_state(F.lit(0), F.lit(None).cast("string"), F.lit(0).cast("long")), after)
    return put.select(ident, last.alias("x")).select(ident, F.element_at(F.array(*map(F.lit, STATES)), F.col("x.s") + 1).alias("state"), F.col("x.c").alias("call"), F.col("x.r").alias("rejected"))


# ---- commands

# What a command line may not hold, and the programs that it may begin with.
SHELL_TOKENS = ("|", ">", "<", "&&", "||", ";", "$", "`")
PYTHONS = ("python", "python3", "python3.6", "python3.7", "python3.8", "python3.9")
PYTESTS = ("pytest", "py.test")

# Distributions of modules that have another name, and pins that are replaced if they can't be installed.
DISTRIBUTIONS = {
    "attr": "attrs", "yaml": "pyyaml", "dateutil": "python-dateutil", "cv2": "opencv-python", "ansible": "ansible-base", "bs4": "beautifulsoup4", "sklearn": "scikit-learn", "pil": "pillow",
    "crypto": "pycryptodome", "openssl": "pyopenssl", "pydispatch": "pydispatcher", "past": "future", "requests_async": "requests-async", "_black_version": "setuptools-scm",
}
REPLACED_PINS = {
    "numpy==1.19.0rc2": "numpy==1.19.0", "scipy==1.5.0rc1": "scipy==1.5.0", "ansible-base==2.10.0.dev0": "ansible-base==2.10.0", "jinja2==3.0.0a1": "jinja2==3.0.0", "markupsafe==2.0.0a1": "markupsafe==2.0.0",
    "typed-ast==1.4.0": "typed-ast==1.5.5", "typed-ast==1.4.1": "typed-ast==1.5.5",
}


def words(line: Column) -> Column:
    """The words of a command line as a POSIX shell parts them by blanks, quotes and backslashes; null if a quote stays open.

    One fold over the characters. mode: 0 outside, 1 and 2 inside single and double quotes, 3 and 4 after a backslash outside
    and inside double quotes. open: whether a word has begun, which an empty pair of quotes does too.
    """
    none = F.array().cast("array<string>")
    start = F.struct(F.lit(0).alias("mode"), F.lit("").alias("word"), F.lit(False).alias("open"), none.alias("found"))

    def step(s: Column, c: Column) -> Column:
        mode, blank = s["mode"], c.isin(" ", "\t", "\r", "\n")
        ends = (mode == 0) & blank
        quote = (mode == 0) & c.isin("'", '"', "\\") | (mode == 1) & (c == "'") | (mode == 2) & c.isin('"', "\\")
        to = F.when(mode == 0, F.when(c == "'", 1).when(c == '"', 2).when(c == "\\", 3).otherwise(0)).when(mode == 1, F.when(c == "'", 0).otherwise(1)).when(mode == 2, F.when(c == '"', 0).when(c == "\\", 4).otherwise(2)).when(mode == 3, 0).otherwise(2)
        # Inside double quotes a backslash stands for itself unless a quote or another one follows.
        text = F.when((mode == 4) & ~c.isin('"', "\\"), F.concat(F.lit("\\"), c)).otherwise(c)
        return F.struct(
            to.alias("mode"),
            F.when(ends, "").when(quote, s["word"]).otherwise(F.concat(s["word"], text)).alias("word"),
            (~ends & (s["open"] | ~blank | (mode != 0))).alias("open"),
            F.when(ends & s["open"], F.concat(s["found"], F.array(s["word"]))).otherwise(s["found"]).alias("found"),
        )

    end = lambda s: F.when(s["mode"] == 0, F.when(s["open"], F.concat(s["found"], F.array(s["word"]))).otherwise(s["found"]))
    return F.aggregate(F.filter(F.split(line, ""), lambda c: c != ""), start, step, end)


def _arguments(args: Column, python: str) -> Column:
    """The arguments that are run for the words of a line; null if its program isn't one that may be run."""
    first, rest = F.try_element_at(args, F.lit(1)), F.slice(args, 2, F.size(args))
    node = F.forall(rest, lambda x: F.contains(x, F.lit("::")) & F.substring_index(x, "::", 1).endswith(".py")) & (F.size(rest) > 0)
    module = F.concat(F.array(*map(F.lit, (python, "-m", "pytest"))), rest)
    return F.when(first.isin(*PYTHONS), F.concat(F.array(F.lit(python)), rest)).when(first.isin(*PYTESTS) | ((first == "tox") & node), module)


def commands(text: Column, python: str = "python") -> Column:
    """array<array<string>>: the argument lists of a script of test commands, one for each line; null if any line may not be run.

    Blank lines and comments are left out. Lines with the syntax of a shell, open quotes, or programs other than Python,
    pytest and tox with plain test nodes are refused, and so is a script without commands.
    """
    lines = F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.trim(x, F.lit(" \t\f"))), lambda x: (x != "") & ~x.startswith("#"))
    refused = F.exists(lines, lambda x: F.greatest(*(F.contains(x, F.lit(t)) for t in SHELL_TOKENS)))
    parted = F.transform(lines, words)
    made = F.transform(F.filter(parted, lambda a: a.isNull() | (F.size(a) > 0)), lambda a: _arguments(a, python))
    sound = F.coalesce(~refused, F.lit(False)) & (F.size(made) > 0) & F.forall(made, lambda a: a.isNotNull())
    return F.when(sound, made)


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def requirement_for(module: Column, requirements: Column) -> Column:
    """The first requirement whose package provides a module, else the package's plain name."""
    root = F.lower(F.substring_index(module, ".", 1))
    expected = F.coalesce(F.try_element_at(_map(DISTRIBUTIONS), root), F.replace(root, F.lit("_"), F.lit("-")))
    package = lambda r: F.replace(F.lower(F.element_at(F.split(r, r"[<>=!~\[\s]", 2), 1)), F.lit("_"), F.lit("-"))
    return F.coalesce(F.try_element_at(F.filter(requirements, lambda r: package(r) == expected), F.lit(1)), expected)


def installation_candidates(requirement: Column) -> Column:
    """A requirement, and what replaces its pin if that can't be installed."""
    other = F.try_element_at(_map(REPLACED_PINS), F.replace(F.lower(requirement), F.lit(" "), F.lit("")))
    return F.array_compact(F.array(requirement, other))
