"""Scalar functions as Column builders; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"(?U)\s"
# Labels of well-known media types.
MIME_LABELS = {
    "application/pdf": "PDF", "text/plain": "TXT", "text/csv": "CSV", "text/tab-separated-values": "TSV", "text/markdown": "MD", "text/html": "HTML",
    "application/json": "JSON", "application/x-ndjson": "JSONL", "application/rtf": "RTF", "image/png": "PNG", "image/jpeg": "JPEG", "image/gif": "GIF",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "DOCX", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "XLSX",
    "application/vnd.ms-excel": "XLS", "application/vnd.apache.parquet": "PARQUET", "audio/mpeg": "MP3", "audio/wav": "WAV", "video/mp4": "MP4",
}
# Media types by file ending.
MIME_BY_ENDING = {
    "csv": "text/csv", "tsv": "text/tab-separated-values", "txt": "text/plain", "md": "text/markdown", "html": "text/html", "json": "application/json",
    "jsonl": "application/x-ndjson", "ndjson": "application/x-ndjson", "pdf": "application/pdf", "rtf": "application/rtf", "png": "image/png", "gif": "image/gif",
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "parquet": "application/vnd.apache.parquet",
}


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, rf"{WHITE[:4]}^\s+|\s+$", "")


def non_blank(c: Column) -> Column:
    """The stripped text, null where nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def clean(c: Column) -> Column:
    """Line feeds only, no blanks before them, at most one empty line and single blanks; stripped."""
    for pattern, to in ((r"\r\n?", "\n"), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " ")):
        c = F.regexp_replace(c, pattern, to)
    return strip(c)


def squeeze(c: Column, most: int = 20) -> Column:
    """Longer runs of one visible character cut to ``most``."""
    return F.regexp_replace(c, rf"(\S)\1{{{most},}}", "$1" * most)


def compact_ascii(c: Column) -> Column:
    """ASCII letters and digits only, lower case."""
    return F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))


def compact_unicode(c: Column) -> Column:
    """Letters and digits of any script, lower case."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def cluster_key(text: Column, kind: Column, mode: str = "orthographic") -> Column:
    """Key under which spellings of one entity meet; ``exact`` keeps punctuation apart."""
    lower = F.lower(strip(text))
    form = F.coalesce(F.nullif(compact_ascii(text), F.lit("")), lower) if mode == "orthographic" else lower
    return F.concat(form, F.lit("::"), F.lower(kind))


def entity_type(c: Column) -> Column:
    return F.coalesce(non_blank(c), F.lit("Unlabeled"))


def mime_label(c: Column) -> Column:
    """A short label for a media type: a known one, else its subtype in capitals."""
    known = F.create_map(*[F.lit(x) for kv in MIME_LABELS.items() for x in kv])
    rest = F.upper(F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), "^[^/]*/", ""), r"^(x-|vnd\.)", ""), 1, 12))
    return F.coalesce(F.try_element_at(known, F.lower(c)), F.nullif(rest, F.lit("")), F.lit("UNKNOWN"))


def mime_of_name(c: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in MIME_BY_ENDING.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.lower(F.regexp_extract(c, r"\.([A-Za-z0-9]+)$", 1))), F.lit("application/octet-stream"))


def estimated_tokens(c: Column, ratio: float = 3.5) -> Column:
    return F.ceil(F.length(c) / F.lit(ratio)).cast("long")


def fits(c: Column, budget: int, margin: float = 0.95) -> Column:
    return estimated_tokens(c) <= int(budget * margin)


def short_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def clock(seconds: Column) -> Column:
    """HH:MM:SS of seconds, half to even; 00:00:00 for what is no time."""
    s = F.bround(F.when((seconds >= 0) & ~F.isnan(seconds) & (seconds < 1e12), seconds), 0).cast("long")
    hms = F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
    return F.when(s.isNull(), "00:00:00").otherwise(hms)


def seconds(c: Column) -> Column:
    """Seconds of [[HH:]MM:]SS[.f]; null if a part is no number, or minutes or seconds reach 60."""
    parts = F.reverse(F.transform(F.split(strip(c), ":"), lambda x: x.try_cast("double")))
    s, m, h = (F.try_element_at(parts, F.lit(i)) for i in (1, 2, 3))
    n = F.size(parts)
    ok = n.between(1, 3) & ~F.exists(parts, lambda x: x.isNull() | (x < 0)) & ((n == 1) | (s < 60)) & ((n < 3) | (m < 60))
    return F.when(ok, s + 60 * F.coalesce(m, F.lit(0.0)) + 3600 * F.coalesce(h, F.lit(0.0)))


def readable_bytes(c: Column) -> Column:
    out = F.format_string("%d B", c)
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")):
        out = F.when(c >= 1024**power, F.format_string(f"%.1f {unit}", c / float(1024**power))).otherwise(out)
    return out


def counter(c: Column, part: int) -> Column:
    """The first (1) or second (2) number of the first n/m in a message."""
    return F.nullif(F.regexp_extract(c, r"(\d+)\s*/\s*(\d+)", part), F.lit("")).try_cast("long")


def progress_key(c: Column) -> Column:
    return F.regexp_replace(c, r"\d+", "#")


# How models mark their reasoning, by tags and by channels.
THINK, THINK_OPEN, THINK_CLOSE = r"(?is)<think\b[^>]*>(.*?)</think\s*>", r"(?i)<think\b[^>]*>", r"(?i)</think\s*>"
CHANNEL = r"(?is)<\|channel\|>\s*%s\s*<\|message\|>(.*?)(?=<\|end\|>|<\|return\|>|<\|channel\|>|\z)"
STOPS = r"(?i)<\|(?:end|return|start|constrain)\|>"


def of_channels(c: Column) -> Column:
    """The first final channel, if there is one; else the text without analysis channels."""
    final = CHANNEL % "final"
    return F.when(c.rlike(final), strip(F.regexp_extract(c, final, 1))).otherwise(F.regexp_replace(c, CHANNEL % "analysis", ""))


def without_reasoning(c: Column) -> Column:
    """An answer without what its model thought: channels and <think> blocks; what stands before a closing tag that was never opened,
    and after an opening one that never closes, is thought, too."""
    out = F.regexp_replace(of_channels(c), THINK, "")
    closes, opens = F.regexp_instr(out, F.lit(THINK_CLOSE)), F.regexp_instr(out, F.lit(THINK_OPEN))
    out = F.when((closes > 0) & ((opens == 0) | (closes < opens)), F.regexp_replace(out, r"(?is)\A.*?</think\s*>", "")).otherwise(out)
    return strip(F.regexp_replace(F.regexp_replace(out, r"(?is)<think\b[^>]*>.*", ""), STOPS, ""))


def reasoning(c: Column) -> Column:
    """What without_reasoning takes out, without its marks, a line for each part; null if there is nothing."""
    rest = of_channels(c)
    bare = F.regexp_replace(rest, THINK, "")
    closes, opens = F.regexp_instr(bare, F.lit(THINK_CLOSE)), F.regexp_instr(bare, F.lit(THINK_OPEN))
    dangling = (closes > 0) & ((opens == 0) | (closes < opens))
    before, after = F.when(dangling, F.regexp_extract(bare, r"(?is)\A(.*?)</think\s*>", 1)), F.regexp_extract(bare, r"(?is)<think\b[^>]*>(.*)", 1)
    parts = F.concat(F.regexp_extract_all(c, F.lit(CHANNEL % "analysis"), 1), F.regexp_extract_all(rest, F.lit(THINK), 1), F.array(before, after))
    return F.nullif(F.array_join(F.filter(F.transform(parts, strip), lambda x: x != ""), "\n"), F.lit(""))


def clamped(c: Column, most: int = 1024, mark: str = "… [truncated]") -> Column:
    """One line of at most ``most`` characters, with a mark where it was cut."""
    flat = F.regexp_replace(c, r"[\r\n\t]+", " ")
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit(mark))).otherwise(flat)


def cut_body(c: Column, allowance: int) -> Column:
    """The text, or its beginning and a note of how much isn't shown."""
    n = F.length(c)
    return F.when(n <= allowance, c).otherwise(F.concat(F.substring(c, 1, allowance), F.format_string("[... %d of %d characters not shown ...]", n - allowance, n)))


def preview(c: Column, most: int = 600) -> Column:
    return F.substring(c, 1, most)


def title(c: Column, most: int = 50) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def strip_counter(c: Column) -> Column:
    """Without one trailing _digits."""
    return F.regexp_replace(c, r"_\d+$", "")


def tokens(c: Column) -> Column:
    """Search tokens: lower-case runs of letters, digits and underscores with 2 to 30 characters."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda x: F.length(x).between(2, 30))


def hour_bucket(author: Column, at: Column) -> Column:
    """author::UTC hour, with names for what is missing."""
    return F.concat(F.coalesce(non_blank(author), F.lit("unknown")), F.lit("::"), F.coalesce(F.date_format(at, "yyyy-MM-dd'T'HH"), F.lit("undated")))


def physical_name(owner: Column, name: Column) -> Column:
    return F.concat(F.lit("u"), F.substring(F.sha2(owner, 256), 1, 12), F.lit("__"), name)


def html_text(c: Column) -> Column:
    """Visible text of a page: no scripts, styles, comments or tags, common entities decoded, white space single."""
    c = F.regexp_replace(c, r"(?is)<!--.*?-->|<(script|style|noscript)\b.*?</\1\s*>|<[^>]*>", " ")
    for name, to in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(to))
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def csv_cell(c: Column, is_array: bool = False) -> Column:
    """An export cell: null is empty, a list is joined by semicolons without its nulls."""
    return F.coalesce(F.array_join(c, ";") if is_array else c.cast("string"), F.lit(""))


# Phrases of answers that tell that nothing was found, of answers that no image came, and words that show what is asked for.
WEAK_PHRASES = (
    "evidence insufficient", "evidence is insufficient", "i couldn't generate", "cannot answer based on the provided", "the retrieved context does not", "no information", "keine informationen", "keine belege",
    "unzureichende belege", "belege sind unzureichend", "kann auf grundlage der bereitgestellten", "konnte keine antwort",
)
NO_IMAGE = (
    "i don't see any image", "i do not see any image", "i don't see an image", "i do not see an image", "no image attached", "no image provided", "no image was attached", "no image was provided",
    "i cannot see an image", "i can't see an image", "there is no image", "there's no image", "you haven't provided an image", "you have not provided an image", "image is not attached", "image wasn't attached",
)
NO_IMAGE_IF_SHORT = ("please provide the document image", "please provide the image", "please share the image")
INTENTS = {"ner": ("entity", "extract", "ner", "relation"), "table": ("table", "row", "column", "csv"), "summary": ("summary", "summarize", "overview")}


def holds_any(c: Column, phrases: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(c, p))


def weak_answer(c: Column) -> Column:
    """Shorter than 40 characters, or with a phrase that says that nothing was found."""
    return F.coalesce(F.length(strip(c)) < 40, F.lit(True)) | holds_any(F.lower(c), WEAK_PHRASES)


def no_image_refusal(c: Column) -> Column:
    """Does the answer say that no image came? Some phrases count in short answers only."""
    low = strip(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s+", " "))
    return holds_any(low, NO_IMAGE) | ((F.length(low) <= 160) & holds_any(low, NO_IMAGE_IF_SHORT))


def intent(c: Column) -> Column:
    """The first intent of which a keyword occurs, in any case; 'qa' without one."""
    low = F.lower(c)
    out = F.lit("qa")
    for name, words in reversed(INTENTS.items()):
        out = F.when(holds_any(low, words), name).otherwise(out)
    return out


def understood(c: Column) -> Column:
    """struct<intent, confidence, reason, query, page> of a question; the page is the number behind the word."""
    kind = intent(c)
    return F.struct(
        kind.alias("intent"), F.when(kind == "qa", 0.6).otherwise(0.8).alias("confidence"), F.when(kind != "qa", F.concat(F.lit("matched keywords for "), kind)).alias("reason"),
        F.nullif(c, F.lit("")).alias("query"), F.nullif(F.regexp_extract(c, r"(?i)page\s*(\d+)", 1), F.lit("")).alias("page"),
    )
