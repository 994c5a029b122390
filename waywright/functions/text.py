"""Column builders for what is shown: times, distances, ordinals, reasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from . import labels


def in_locale(c: Column | str) -> Column:
    """A text that compares as readers order it: letters before accents before case, by the root collation; texts it holds for equal want the plain text beside it."""
    return F.collate(F.col(c) if isinstance(c, str) else c, "UNICODE")


def fixed(x: Column, digits: int) -> Column:
    """A number with up to six digits after the point, as its exact binary value rounds; of two that are as near, the one farther from zero.

    What lies behind the point is taken apart into two whole numbers of 40 bits, so nothing is
    lost from 2^-80 on; smaller parts are nowhere near a half of any digit asked for.
    """
    size, ten, half = F.abs(x.cast("double")), 10**digits, 1 << 39
    whole = F.floor(size)
    high = F.floor((size - whole) * F.lit(2.0**40))
    low = F.floor(((size - whole) * F.lit(2.0**40) - high) * F.lit(2.0**40))
    scaled = high * ten + F.shiftright(low * ten, 40)
    digit = F.shiftright(scaled, 40) + (scaled.bitwiseAND(F.lit((1 << 40) - 1)) >= half).cast("long")
    shown = (whole + (digit == ten).cast("long")).cast("string")
    if digits:
        shown = F.concat(shown, F.lit("."), F.lpad((digit % ten).cast("string"), digits, "0"))
    return F.when(F.isnan(x.cast("double")) | (size >= F.lit(2.0**62)), x.cast("string")).otherwise(F.concat(F.when(x < 0, "-").otherwise(""), shown))


def elapsed(ms: Column) -> Column:
    """m:ss, or h:mm:ss from an hour on; negatives count as zero."""
    s = F.greatest(F.lit(0), F.floor(ms / 1000)).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    hours, minutes, seconds = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(hours > 0, F.concat(hours.cast("string"), F.lit(":"), two(minutes), F.lit(":"), two(seconds))).otherwise(F.concat(F.floor(s / 60).cast("string"), F.lit(":"), two(seconds)))


def signed_delta(ms: Column) -> Column:
    return F.when(ms == 0, F.lit("0:00")).otherwise(F.concat(F.when(ms < 0, F.lit("-")).otherwise(F.lit("+")), elapsed(F.abs(ms))))


def ordinal(n: Column) -> Column:
    teens = (n % 100).between(11, 13)
    end = F.when(teens, "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def percent(share: Column) -> Column:
    usable = share.isNotNull() & ~F.isnan(share) & (F.abs(share) < F.lit(float("inf")))
    return F.when(usable, F.concat(F.floor(F.greatest(F.lit(0.0), share) * 100 + 0.5).cast("long").cast("string"), F.lit("%"))).otherwise(F.lit("0%"))


def distance(meters: Column) -> Column:
    """Whole metres, or kilometres with one decimal from 1000 m on."""
    return F.when(meters >= 1000, F.concat(fixed(meters / 1000, 1), F.lit(" km"))).otherwise(F.concat(F.floor(meters + 0.5).cast("long").cast("string"), F.lit(" m")))


def wait_duration(ms: Column) -> Column:
    return F.concat(F.greatest(F.lit(0), F.floor(ms / 1000)).cast("long").cast("string"), F.lit("s"))


def wait_delta(ms: Column) -> Column:
    s = F.floor(F.abs(ms) / 1000 + 0.5).cast("long")
    return F.when(s == 0, F.lit("0s")).otherwise(F.concat(F.when(ms < 0, F.lit("-")).otherwise(F.lit("+")), s.cast("string"), F.lit("s")))


def into_route(progress: Column) -> Column:
    return F.coalesce(F.concat(distance(progress), F.lit(" into route")), F.lit("Location unavailable"))


def rank_among(rank: Column, total: Column) -> Column:
    return F.concat(ordinal(rank), F.lit(" fastest of "), total.cast("string"))


def time_of_day(ms: Column) -> Column:
    """Hour (not padded), minute and second in the session's zone."""
    return F.date_format(F.timestamp_millis(ms.cast("long")), "H:mm:ss")


def attempt_stamp(ms: Column) -> Column:
    """Date and time of day in the session's zone."""
    return F.concat_ws(" ", F.date_format(F.timestamp_millis(ms.cast("long")), "yyyy-MM-dd"), time_of_day(ms))


def named(code: Column, names: dict[str, str], other: Column | None = None) -> Column:
    """The text that belongs to a code; for others ``other``, or null."""
    found = F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), code)
    return found if other is None else F.coalesce(found, other)


def mode_label(mode: Column) -> Column:
    return named(mode, labels.MODES, mode)


def mode_icon(mode: Column) -> Column:
    return named(mode, labels.MODE_ICONS, F.lit(""))


def endpoint_label(kind: Column, name: Column) -> Column:
    """Start, Finish, or a checkpoint's name."""
    return named(kind, labels.ENDPOINTS, name)


def fix_age(ms: Column) -> Column:
    """How old the last fix is: seconds, from a minute on minutes and seconds; negatives count as zero."""
    s = F.greatest(F.lit(0), F.floor(ms / 1000)).cast("long")
    short = F.concat(s.cast("string"), F.lit("s ago"))
    return F.when(s < 60, short).otherwise(F.concat(F.floor(s / 60).cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s ago")))


def fix_health(age_ms: Column, stale_ms: int = K.STALE_MS) -> Column:
    return F.when(age_ms.isNull(), "waiting_for_first_fix").when(age_ms >= stale_ms, "stale").otherwise("healthy")


def radius_input(text: Column) -> Column:
    """The number in a zone radius as typed, a comma allowed for the point; null for anything else.

    Decimal numbers with or without an exponent, whole numbers in base 16, 8 or 2 after their
    prefix, and Infinity; letters or signs around these make it no number.
    """
    typed = F.regexp_replace(F.regexp_replace(text, "(?U)^[\\s\uFEFF]+|[\\s\uFEFF]+$", ""), "^([^,]*),", "$1.")
    based = [(16, "^0[xX][0-9a-fA-F]{1,12}$"), (8, "^0[oO][0-7]{1,16}$"), (2, "^0[bB][01]{1,48}$")]
    out = F.when(typed.rlike("^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?Infinity$"), typed.try_cast("double"))
    for base, pattern in based:
        out = out.when(typed.rlike(pattern), F.conv(F.substring(typed, F.lit(3), F.length(typed)), base, 10).try_cast("double"))
    return out


def unranked_warning(lifecycle: Column, validity: Column, analysed: Column) -> Column:
    """Whether to warn that a completed attempt isn't ranked: only where no analysis of it is at hand."""
    return (lifecycle == "completed") & (validity != "valid") & ~analysed


def waiting_share(waiting_ms: Column, official_ms: Column) -> Column:
    """Waiting as a share of official time, in percent."""
    return percent(F.when(official_ms > 0, waiting_ms / official_ms).otherwise(0.0))


def history_meta(eligible: Column, official_ms: Column, is_pb: Column, rank: Column) -> Column:
    """What a row of the history says: its time, and whether it is the best or which it is."""
    time = elapsed(official_ms)
    mark = F.when(is_pb, "PB").when(rank.isNotNull(), ordinal(rank))
    return F.when(~eligible | official_ms.isNull(), "Unavailable").otherwise(F.concat_ws(" · ", time, mark))


def delta_tone(delta_ms: Column) -> Column:
    return F.when(delta_ms < 0, "faster").when(delta_ms > 0, "slower").otherwise("neutral")


def comparison_tone(delta_ms: Column) -> Column:
    return F.when(delta_ms > 0, "more").when(delta_ms < 0, "less").otherwise("wait")


def stop_count(n: Column) -> Column:
    return F.when(n == 1, "1 stop").otherwise(F.concat(n.cast("string"), F.lit(" stops")))


def new_id() -> Column:
    """A random id for each row; write the rows before they are used twice."""
    return F.uuid()
