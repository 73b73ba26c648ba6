"""Text functions: JSON forms, identities, rendering, buckets and words for snapshots."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


def canonical_json(value: object) -> str:
    """Sorted keys, no spaces, UTF-8 kept, NaN and infinities refused."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def digest(value: object) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def _refuse(name: str) -> float:
    raise ValueError(f"{name} is not JSON")


@F.pandas_udf(StringType())
def canonical(raw: pd.Series) -> pd.Series:
    """Canonical form of JSON text; null where it is not JSON.

    A pandas UDF, as number formatting and repeated keys must follow Python's.
    """
    def one(text):
        try:
            return canonical_json(json.loads(text, parse_constant=_refuse))
        except (TypeError, ValueError):
            return None

    return raw.map(one)


@F.pandas_udf(StringType())
def indented(raw: pd.Series) -> pd.Series:
    """An entry as prompt text: null is empty, a JSON string is itself, all else is indented by two."""
    return raw.map(_indented)


@F.pandas_udf(ArrayType(StringType()))
def all_indented(raw: pd.Series) -> pd.Series:
    """The same for every entry of an array; null for a null array."""
    return raw.map(lambda entries: None if entries is None else [_indented(e) for e in entries])


def _indented(text: str | None) -> str:
    if text is None:
        return ""
    value = json.loads(text)
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, indent=2, ensure_ascii=False)


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def json_string(text: Column) -> Column:
    """A string as JSON text."""
    return F.regexp_replace(F.to_json(F.struct(text.alias("s"))), r'(?s)^\{"s":(.*)\}$', "$1")


def input_fingerprint(state_json: Column, question: Column, texts: Column) -> Column:
    """Digest of canonical state, question and sorted candidate texts; blind to ids and order.

    ``state_json`` must be canonical already (see ``canonical``).
    """
    listed = F.array_join(F.transform(F.array_sort(texts), json_string), ",")
    return sha256(F.concat(F.lit('{"candidates":['), listed, F.lit('],"question":'), json_string(question), F.lit(',"state":'), state_json, F.lit("}")))


def render_context(state_json: Column, question: Column) -> Column:
    return F.concat(F.lit("State:\n"), state_json, F.lit("\n\nQuestion:\n"), question)


def block(title: str, body: Column) -> Column:
    """A titled block, or nothing for an empty body."""
    return F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(f"{title}:\n"), body, F.lit("\n\n"))).otherwise(F.lit(""))


def position_of(fen: Column) -> Column:
    """The first four fields of a FEN."""
    return F.array_join(F.slice(F.split(F.trim(fen), r"\s+"), 1, 4), " ")


def game_identity(game_id: Column, *urls: Column) -> Column:
    """The first of the values that is not empty; a game link becomes its 8-character id, another link its address alone."""
    raw = F.trim(F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in (game_id, *urls)]))
    host = F.lower(F.regexp_extract(raw, r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_extract(raw, r"^[a-zA-Z][\w+.-]*://[^/?#]*/([^/?#]*)", 1)
    known = host.isin("lichess.org", "www.lichess.org") & path.rlike(r"^(?:[A-Za-z0-9]{8}|[A-Za-z0-9]{12})$")
    address = F.regexp_replace(F.regexp_replace(raw, r"[?#].*$", ""), r"/+$", "")
    return F.nullif(F.when(known, F.substring(path, 1, 8)).when(host != "", address).otherwise(raw), F.lit(""))


def candidate_bucket(n: Column) -> Column:
    return F.when(n == 1, "1").when(n <= 10, "2-10").when(n <= 25, "11-25").otherwise("26+")


def rating_bucket(rating: Column) -> Column:
    return F.when(rating.isNull(), F.lit(None)).when(rating < 1000, "<1000").when(rating < 1400, "1000-1399").when(rating < 1800, "1400-1799").otherwise("1800+")


def board(fen: Column) -> Column:
    """A position as text: rank 8 on top, files a to h, a dot for an empty square."""
    cells = F.split(fen, r"\s+")[0]
    for n in range(8, 0, -1):
        cells = F.replace(cells, F.lit(str(n)), F.lit("." * n))
    ranks = F.transform(F.split(cells, "/"), lambda r, i: F.concat((8 - i).cast("string"), F.lit(" "), F.array_join(F.split(r, ""), " ")))
    return F.concat(F.array_join(F.transform(ranks, F.rtrim), "\n"), F.lit("\n  a b c d e f g h"))


def chess_prompt(fen: Column, moves: Column) -> Column:
    """The question for a position, with its legal moves given as an array."""
    side = F.when(F.split(fen, r"\s+")[1] == "w", "white").otherwise("black")
    return F.concat(F.lit("You are playing chess as "), side, F.lit(". Pick the best move.\n\nBoard (uppercase = white, lowercase = black):\n"), board(fen), F.lit("\n\nFEN: "), fen, F.lit("\nLegal moves: "), F.array_join(moves, " "), F.lit("\nBest move:"))


def bar(fraction: Column, width: int = 20) -> Column:
    return F.concat(F.repeat(F.lit("█"), F.round(fraction * width).cast("int")), F.format_string(" %.0f%%", fraction * 100))


# Names and words of the game's text form.
PRETTY = {
    "DoomImp": "imp", "ShotgunGuy": "shotgun zombie", "Zombieman": "zombie", "ChaingunGuy": "chaingunner", "HellKnight": "hell knight",
    "BaronOfHell": "baron", "LostSoul": "lost soul", "Cacodemon": "cacodemon", "Demon": "pinky demon", "Spectre": "spectre",
    "MarineChainsaw": "chainsaw marine", "GreenArmor": "green armor", "BlueArmor": "blue armor", "Medikit": "medkit", "Stimpack": "stimpack",
    "Clip": "ammo clip", "ClipBox": "box of bullets", "ShellBox": "box of shells", "Shell": "shells", "HealthBonus": "health bonus", "ArmorBonus": "armor bonus",
}
#: Fixed values too: words by the first bound that a value is under (or, where marked, not over).
WHERE = [(0.15, False, "at the far left edge"), (0.38, False, "on the left"), (0.46, False, "slightly left of center"), (0.54, True, "dead center, in the crosshair"), (0.62, True, "slightly right of center"), (0.85, True, "on the right")]
WHERE_ELSE = "at the far right edge"
#: Words by the first bound that a size is over.
RANGE = [(0.55, "point blank"), (0.3, "close"), (0.15, "at medium range")]
RANGE_ELSE = "far away"
DEPTH = [(9, "a wall right in your face"), (18, "a wall close by"), (36, "some room to move")]
DEPTH_ELSE = "open space"


def _ladder(rungs: list[tuple[Column, str]], rest: str) -> Column:
    out = None
    for test, word in rungs:
        out = F.when(test, word) if out is None else out.when(test, word)
    return out.otherwise(rest)


def where_words(cx: Column) -> Column:
    return _ladder([(cx <= b if closed else cx < b, w) for b, closed, w in WHERE], WHERE_ELSE)


def range_words(size: Column) -> Column:
    return _ladder([(size > b, w) for b, w in RANGE], RANGE_ELSE)


def depth_words(depth: Column) -> Column:
    return _ladder([(depth < b, w) for b, w in DEPTH], DEPTH_ELSE)


def pretty_name(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in PRETTY.items() for x in pair])
    return F.coalesce(F.try_element_at(known, name), F.lower(name))


def actor_kind(name: Column, monsters: list[str], items: list[str], size: Column | None = None) -> Column:
    """monster, item, or null for what is neither or, given its size, has none."""
    kind = F.when(name.isin(*monsters) | name.endswith("Vzd"), "monster").when(name.isin(*items), "item")
    return kind if size is None else F.when(size > 0, kind)


def situation(things: Column, center: Column, left: Column, right: Column) -> Column:
    """What is on screen: up to four monsters and two items in their order, and the depths."""
    some = lambda kind, n: F.slice(F.filter(things, lambda t: t["kind"] == kind), 1, n)
    monsters, items = some("monster", 4), some("item", 2)
    seen = F.transform(monsters, lambda t: F.concat(F.lit("A "), pretty_name(t["name"]), F.lit(" "), where_words(t["cx"]), F.lit(", "), range_words(t["size"]), F.lit(".")))
    found = F.transform(items, lambda t: F.concat(F.lit("A "), pretty_name(t["name"]), F.lit(" pickup "), F.replace(where_words(t["cx"]), F.lit(", in the crosshair"), F.lit("")), F.lit(", "), range_words(t["size"]), F.lit(".")))
    depths = F.concat(F.lit("Straight ahead: "), depth_words(center), F.lit(". Left: "), depth_words(left), F.lit(". Right: "), depth_words(right), F.lit("."))
    return F.array_join(F.concat(F.when(F.size(seen) > 0, seen).otherwise(F.array(F.lit("No monsters in view."))), F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("No items in view."))), F.array(depths)), " ")


def median(values: Column) -> Column:
    """The middle value of an array of numbers, or the mean of the two middle ones; null of an empty array."""
    n, order = F.size(values), F.array_sort(values)
    at = lambda k: F.get(order, F.floor(k).cast("int"))
    return F.when(n > 0, (at((n - 1) / 2) + at(n / 2)) / 2)


def band(frame: Column, width: int, rows: tuple[int, int], columns: tuple[int, int]) -> Column:
    """The values of some rows and columns of a frame, an array that has its rows of ``width`` one after another."""
    return F.flatten(F.array(*[F.slice(frame, r * width + columns[0] + 1, columns[1] - columns[0]) for r in range(*rows)]))


def depth_bands(frame: Column, width: int, height: int) -> Column:
    """Medians of a depth frame's middle third: ``left`` and ``right`` fifth and ``center`` fifth of its columns.

    Borders are rounded down; the right fifth is rounded up.
    """
    rows = (height // 3, 2 * height // 3)
    parts = {"left": (0, width // 5), "center": (2 * width // 5, 3 * width // 5), "right": (width - -(-width // 5), width)}
    return F.struct(*[median(band(frame, width, rows, c)).cast("double").alias(k) for k, c in parts.items()])


def status(health: Column, ammo: Column, kills: Column, last_action: Column) -> Column:
    last = F.when(F.coalesce(last_action, F.lit("")) != "", F.concat(F.lit(" Last action: "), last_action, F.lit("."))).otherwise(F.lit(""))
    return F.concat(F.lit("Health "), health.cast("string"), F.lit(", ammo "), ammo.cast("string"), F.lit(", kills "), kills.cast("string"), F.lit("."), last)


def game_prompt(goal: str, rules: list[str], examples: list[tuple[str, str]], scene: Column, state: Column) -> Column:
    """The whole context; options are scored after the final arrow."""
    # fixed values: the prompt's sentences
    head = "\n".join([f"You are playing Doom. Goal: {goal}", "", "Rules:", *(f"- {r}" for r in rules), "", "Examples:", *(f"Situation: {s} -> {a}" for s, a in examples), "", "Situation: "])
    return F.concat(F.lit(head), scene, F.lit("\n"), state, F.lit("\n->"))


def game_state(things: Column, center: Column, left: Column, right: Column, health: Column, ammo: Column, kills: Column, last_action: Column) -> Column:
    """The same observation as a struct."""
    some = lambda kind, n: F.transform(F.slice(F.filter(things, lambda t: t["kind"] == kind), 1, n), lambda t: F.struct(pretty_name(t["name"]).alias("kind"), where_words(t["cx"]).alias("position"), range_words(t["size"]).alias("range")))
    space = F.struct(depth_words(center).alias("ahead"), depth_words(left).alias("left"), depth_words(right).alias("right"))
    return F.struct(some("monster", 4).alias("monsters"), some("item", 2).alias("items"), space.alias("space"), health.alias("health"), ammo.alias("ammo"), kills.alias("kills"), last_action.alias("last_action"))
