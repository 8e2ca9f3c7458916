"""Line-level cleaning as column expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that define each rule.
ANSI = r"\x1b(?:\[[0-?9;]*[ -/]*[@-~]|\][^\x07\x1b]*(?:\x07|\x1b\\)|[@-Z\\-_])|\[\?2026[hl]|\[\?25[hl]"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
PROGRESS = r"(?i)(sandbox:\s*\d+%|\|\s*\d+/\d+\s*\[|\d+/\d+\s*\[.*(?:it/s|s/it|examples/s)\]|Generating \w+ split:|Map:\s*\d+%|\d+/\d+\s*\[|\d+%\|[█▏▎▍▌▋▊▉\s]+\||\[progress\]|examples\s*\[|^\s*\d+\s+examples\s*\[)"
DOWNLOAD = r"(?i)\d+\.?\d*/\d+\.?\d*\s*(?:kB|MB|GB|KiB|MiB|GiB).*(?:eta|s/it|MB/s)"
KILOBYTES = r"(?i)\d+/\d+\s*kB"
NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
BRACKET_ARRAY = rf"\[(?:\s*{NUMBER}\s*,\s*){{4,}}{NUMBER}\s*\]"
BARE_ARRAY = rf"(?<![\w/\:])(?:{NUMBER}\s*,\s*){{4,}}{NUMBER}(?![\w/\:])"
LOGURU_TIME = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?\s*\|\s*\w+\s*\|\s*[a-zA-Z0-9_.]+:[a-zA-Z0-9_]+:\d+\s+-\s"
LOGURU = r"^[a-zA-Z0-9_.]+:[a-zA-Z0-9_]+:\d+\s+-\s"
RUNNER = r"^\d+\.?\d*s(?:\t|\s+)\d+(?:\t|\s+)"
SYSLOG = r"^(?:[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}|\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?)\s+(?:\S+\s+){0,2}"
APACHE = r"(?i)^\[[^\]]+\]\s\[(?:error|warn|notice|info|debug)\]\s"
THREAD_TIME = r"\b\d{4,}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d{3}\b"
HEX_ADDRESS, PID = r"\b0x[0-9a-fA-F]+\b", r"\[\d{4,}\]"
DEEP_PATH = r"(?<![\w.])((?:/[A-Za-z0-9_.\-]+){3,}/)([A-Za-z0-9_.\-]+(?:\.[A-Za-z0-9]+)?)"
SITE_PACKAGES = r"(?i)(?:[A-Za-z]:)?[/\\][\w./\\-]*site-packages[/\\]"
DIST_PACKAGES = r"/usr/local/lib/python[\d.]+/dist-packages/"
LONG_BLOB = r"[A-Za-z0-9+/=_-]{200,}"
ART = r"^[=\s*\\/Oo_\.\(\)\[\]\-]{8,}$|^==\(\(={3,}\)\)==|^[Oo]\s+[Oo]/|^\"-_{3,}-\""
DECORATION, JAVA_GC, BARE_HEX = r"([=*_~#\-])\1{2,}", r"\b\d+K->\d+K\(\d+K\)", r"\b(0x)?[a-fA-F]{8,16}\b"
BOX, EMOJI, BROKEN = "[─-▟]", "[\U0001f300-\U0001f9ff☀-➿]", "�"
MARKERS = r"\[#\d+\]|\[T\d+\]|\[[x×]\d+\]|\[PROGRESS\]"
HOST = r"\b[a-zA-Z0-9][a-zA-Z0-9.-]*\.[a-zA-Z]{2,}\b"
IPV6, IPV4 = r"\b(?:[0-9a-fA-F]{0,4}:){2,7}[0-9a-fA-F]{0,4}\b", r"\b\d{1,3}(?:\.\d{1,3}){3}\b"
STAMP = r"\b(?:\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?|[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\b"
LONG_NUMBER, BRACKETS = r"\b\d{5,}\b", r"[\{\}\[\]\(\)]"
PUNCTUATION = r"[@$^&?*!;'`~<>\\|№#.,/\\:;=\-+_\[\]\(\)\{\}\"]+"
SPECIAL, SPECIAL_EXTRA = r"[\[\]\{\}\^~`@#$%&*+=\\|<>]", r"[.,_/\\:;\-]+"
ALL_NUMBERS = r"[-+]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"
MASKS = r"\[(?:HASH_[A-F0-9]{8}|FLOAT_ARRAY_MASKED|ENTROPY:[A-F0-9]{8}|DICT_EXTRACTED|PROGRESS|Matrix:[^\]]+)\]|<TS>|<ADDR>|\[PID\]"
PROGRESS_TAG = "[PROGRESS]"

_KEPT = "\ue000"


def rx(pattern: str) -> str:
    """A pattern whose classes and word borders cover all of Unicode."""
    return "(?U)" + pattern


def sub(x: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(x, F.lit(rx(pattern)), F.lit(by))


def strip(x: Column) -> Column:
    return sub(x, r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$")


def is_blank(x: Column) -> Column:
    return strip(x) == ""


def keeping(x: Column, pattern: str, change) -> Column:
    """Apply a change to all but the matches of a pattern, which come back where they stood."""
    kept = F.regexp_extract_all(x, F.lit(rx(pattern)), F.lit(0))
    parts = F.split(change(sub(x, pattern, _KEPT)), _KEPT)
    return F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(kept, i), F.lit("")))), "")


def squeeze(x: Column) -> Column:
    return strip(sub(x, r"[ \t]+", " "))


def strip_ansi(x: Column) -> Column:
    return sub(sub(F.substring_index(x, "\r", -1), ANSI), CONTROL)


def is_progress(x: Column) -> Column:
    return x.rlike(rx(DOWNLOAD)) | x.rlike(rx(PROGRESS)) | x.rlike(rx(KILOBYTES))


def tag_progress(x: Column) -> Column:
    return F.when(x.rlike(rx(PROGRESS)), F.lit(PROGRESS_TAG)).otherwise(x)


def mask_arrays(x: Column) -> Column:
    return sub(sub(x, BRACKET_ARRAY, "[FLOAT_ARRAY_MASKED]"), BARE_ARRAY, "[FLOAT_ARRAY_MASKED]")


def tab_spaces(x: Column) -> Column:
    return sub(sub(x, r"[ \t]{2,}", "\t"), r" *\t *", "\t")


def strip_special(x: Column, extra: bool = False, numbers: bool = False) -> Column:
    def change(y: Column) -> Column:
        for pattern in [SPECIAL] + [SPECIAL_EXTRA] * extra + [ALL_NUMBERS] * numbers:
            y = sub(y, pattern, " ")
        return squeeze(y)

    return keeping(x, MASKS, change)


def strip_temporal(x: Column) -> Column:
    for pattern in (LOGURU_TIME, LOGURU, RUNNER, SYSLOG, APACHE):
        x = sub(x, pattern)
    return strip(sub(sub(sub(x, THREAD_TIME, "<TS>"), HEX_ADDRESS, "<ADDR>"), PID, "[PID]"))


def prune_paths(x: Column, workspace: str = "", site_dirs: tuple[str, ...] = ()) -> Column:
    x = sub(x, DEEP_PATH, ".../$2")
    x = sub(sub(x, SITE_PACKAGES, "[SITE-PACKAGES]/"), DIST_PACKAGES, "[SITE-PACKAGES]/")
    for place, name in [(workspace, "[WORKSPACE]")] * (len(workspace) > 3) + [(d, "[SITE-PACKAGES]") for d in site_dirs]:
        x = F.replace(F.replace(x, F.lit(place), F.lit(name)), F.lit(place.replace("/", "\\")), F.lit(name))
    return x


def truncate_blobs(x: Column) -> Column:
    return sub(x, LONG_BLOB, "[LONG_BLOB]")


def entropy(x: Column) -> Column:
    """Shannon entropy of a string's characters, in bits; 0 for the empty string."""
    chars = F.split(x, "")
    share = lambda c: F.size(F.filter(chars, lambda y: y == c)) / F.length(x)
    return F.when(F.length(x) == 0, F.lit(0.0)).otherwise(F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c))))


def scrub_entropy(x: Column, delete: bool = False, size: int = 30, bits: float = 4.5) -> Column:
    """Long random-looking words go, or give way to a short hash; words are joined by single spaces in any case."""
    high = lambda w: (F.length(w) >= size) & (entropy(w) >= bits)
    words = F.filter(F.split(strip(x), r"(?U)\s+"), lambda w: w != "")
    if delete:
        return F.array_join(F.filter(words, lambda w: ~F.coalesce(high(w), F.lit(False))), " ")
    return F.array_join(F.transform(words, lambda w: F.when(high(w), F.concat(F.lit("["), F.substring(F.sha2(w, 256), 1, 4), F.lit("]"))).otherwise(w)), " ")


def is_art(x: Column) -> Column:
    bare = strip(x)
    count = lambda pattern: F.length(bare) - F.length(F.regexp_replace(bare, pattern, ""))
    return (bare != "") & (bare.rlike(rx(ART)) | ((count("=") >= 6) & (count(r"\p{L}") <= 4)))


def collapse_decoration(x: Column) -> Column:
    return F.when(x.rlike(r"^(--- [ab]/|\+\+\+ [ab]/)"), x).otherwise(sub(x, DECORATION, "$1"))


def mask_gc(x: Column) -> Column:
    return sub(x, JAVA_GC, "<NUM>K-><NUM>K(<NUM>K)")


def strip_hex(x: Column) -> Column:
    return sub(x, BARE_HEX, "[HEX]")


def strip_box(x: Column) -> Column:
    return sub(sub(x, BOX), BROKEN)


def mid_clean(x: Column) -> Column:
    """Brackets outside markers go; box drawing, emoji and broken characters go where box drawing or emoji occur."""
    bare = keeping(x, MARKERS, lambda y: squeeze(sub(y, BRACKETS, " ")))
    return F.when(bare.rlike(BOX) | bare.rlike(EMOJI), sub(sub(sub(bare, BOX), EMOJI), BROKEN)).otherwise(bare)


def sanitize(x: Column) -> Column:
    """Hosts, addresses, times, hexadecimal and long numbers go, then brackets; markers stay."""

    def change(y: Column) -> Column:
        for pattern in (HOST, IPV6, IPV4, STAMP, HEX_ADDRESS, LONG_NUMBER, BRACKETS):
            y = sub(y, pattern, " ")
        return squeeze(y)

    return keeping(x, MARKERS, change)


def cluster_mask(x: Column) -> Column:
    """What a line has in common with its like: without hosts' names, punctuation and digits; markers stay."""
    change = lambda y: strip(sub(sub(sub(sub(y, HOST, " HOST "), PUNCTUATION, " "), r"\d"), r"\s+", " "))
    masked = keeping(x, MARKERS + r"|### Block \d+", change)
    return F.when(is_blank(x) | (masked == ""), x).otherwise(masked)


def one_space(x: Column) -> Column:
    return sub(strip(x), r"\s+", " ")


def clean_runner_line(x: Column) -> Column:
    return sub(sub(sub(x, RUNNER), r"^\d+:\s+"), r"\x1b\[[0-9;]*m")


def elapsed_seconds(x: Column) -> Column:
    return F.regexp_extract(x, r"^(\d+\.?\d*)s\s", 1).try_cast("double")


def preview(x: Column, width: int = 40) -> Column:
    flat = one_space(x)
    return F.when(F.length(flat) > width, F.concat(F.substring(flat, 1, width - 3), F.lit("..."))).otherwise(flat)


def numbered(pos: Column, line: Column) -> Column:
    return F.format_string("L%05d | %s", pos, line)


def pytest_success(x: Column) -> Column:
    n = F.coalesce(*[F.nullif(F.regexp_extract(x, p, 1), F.lit("")) for p in (r"(?i)=+\s*(\d+)\s+passed(?:\s+in\s+[\d.]+s)?\s*=+", r"(?i)collected\s+(\d+)\s+item")])
    return F.concat_ws(" ", F.lit("all"), n, F.lit("tests passed"))


def is_machine_json(x: Column) -> Column:
    return F.coalesce(sub(x, r"^\s+").rlike(r"^[\{\[]") & F.try_parse_json(x).isNotNull(), F.lit(False))


def tokens(x: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}\s]", " "), r"(?U)\s+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def merge_output(out: Column, err: Column) -> Column:
    trimmed = [F.nullif(sub(x, r"\s+$"), F.lit("")) for x in (out, err)]
    return F.concat_ws("\n", *trimmed)


def clean_chars(x: Column, ansi: bool = False, progress: str | None = None, arrays: bool = False, tabs: bool = False, extra: bool = False, numbers: bool = False, special: bool = False) -> Column:
    """A line cleaned by the rules asked for, in their fixed order; null where nothing is left, or where ``progress`` is ``drop`` and the line shows progress."""
    kept = strip_ansi(x) if ansi else x
    dropped = kept.rlike(rx(PROGRESS)) if progress == "drop" else F.lit(False)
    kept = tag_progress(kept) if progress == "collapse" else kept
    kept = mask_arrays(kept) if arrays else kept
    kept = tab_spaces(kept) if tabs else kept
    for asked, pattern in ((extra, SPECIAL_EXTRA), (numbers, ALL_NUMBERS), (special, SPECIAL)):
        if asked:
            kept = keeping(kept, MASKS, lambda y, pattern=pattern: squeeze(sub(y, pattern, " ")))
    return F.when(~dropped & ~is_blank(kept), strip(kept))


def signature(x: Column) -> Column:
    """A line with numbers and long words masked, so that lines of one form are alike."""
    return strip(sub(sub(x, r"\d+(?:\.\d+)?", "<N>"), r"\S{20,}", "<BLOB>"))


def stub(x: Column, pos: Column) -> Column:
    """The beginning of a line whose values are kept elsewhere: up to 80 characters of what a module's name comes before, else up to 100."""
    lead = F.regexp_extract(x, rx(r"^(\d+\.?\d*s\s+\d+\s+)?"), 1)
    rest = F.substring(F.regexp_extract(F.substring(x, F.length(lead) + 1, F.length(x)), r"^([^\n]*)", 1), 1, 120)
    head, tail = F.substring_index(rest, " - ", 1), F.substring(rest, F.locate(" - ", rest) + 3, F.lit(80))
    return F.concat(lead, F.when(F.contains(rest, F.lit(" - ")), F.concat(head, F.lit(" - "), tail)).otherwise(F.substring(rest, 1, 100)), F.lit("…"))


def clip(x: Column, width: int) -> Column:
    """Exactly ``width`` characters: cut with a mark, or filled up with spaces."""
    return F.when(F.length(x) > width, F.concat(F.substring(x, 1, width - 1), F.lit("…"))).otherwise(F.rpad(x, width, " "))


def short_date(x: Column) -> Column:
    """Month and day of an ISO time stamp; its first characters where it is none."""
    return F.coalesce(F.date_format(x.try_cast("timestamp"), "MMM dd"), F.substring(x, 1, 6))
