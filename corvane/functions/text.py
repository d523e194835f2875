"""Text functions: sectioning, cleaning, tagging with offsets, templating.

All are column expressions, so they run inside Spark; none needs a Python worker.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that no report section keeps (fixed values: substrings that mark administrative sentences).
NOTE_WORDS = ("email", "phone", "Dr", "contact", "discuss", "minutes", "review", "dictation", "observation", "communi")
#: Words that show a report compares with an earlier study.
HISTORY_WORDS = ("prior", "previous", "new", "stable", "patient", "history")
#: The header words that name a section when a header holds them.
SECTION_WORDS = ("impression", "findings", "history", "comparison", "addendum")
# Header spellings and the section that each stands for.
SECTION_ALIASES = {
    "preamble": "preamble", "impression": "impression", "comparison": "comparison", "indication": "indication", "findings": "findings", "examination": "examination", "technique": "technique", "history": "history",
    "comparisons": "comparison", "clinical history": "history", "reason for examination": "indication", "notification": "notification", "reason for exam": "indication", "clinical information": "history", "exam": "examination",
    "clinical indication": "indication", "conclusion": "impression", "chest, two views": "findings", "recommendation(s)": "recommendations", "type of examination": "examination", "reference exam": "comparison", "patient history": "history",
    "addendum": "addendum", "comparison exam": "comparison", "date": "date", "comment": "comment", "findings and impression": "impression", "wet read": "wet read", "comparison film": "comparison", "recommendations": "recommendations",
    "findings/impression": "impression", "pfi": "history", "recommendation": "recommendations", "wetread": "wet read", "ndication": "impression", "impresson": "impression", "imprression": "impression", "imoression": "impression",
    "impressoin": "impression", "imprssion": "impression", "impresion": "impression", "imperssion": "impression", "mpression": "impression", "impession": "impression", "findings/ impression": "impression", "finding": "findings",
    "findins": "findings", "findindgs": "findings", "findgings": "findings", "findngs": "findings", "findnings": "findings", "finidngs": "findings", "idication": "indication", "reference findings": "findings", "comparision": "comparison",
    "comparsion": "comparison", "comparrison": "comparison", "comparisions": "comparison",
}
# View phrases; a header that holds one of them heads findings.
VIEW_WORDS = (
    "chest", "portable", "pa and lateral", "lateral and pa", "ap and lateral", "lateral and ap", "frontal and", "two views", "frontal view", "pa view", "ap view", "one view", "lateral view", "bone window", "frontal upright",
    "frontal semi-upright", "ribs", "pa and lat",
)

SECTION_TYPE = "array<struct<name string, text string, start int>>"
# Fixed value: a section header; the rest of its line is taken with it, since no header may follow there.
_HEADER = r"\n ([A-Z ()/,-]+):[\s\x1C-\x1F\x85\p{Z}][^\n]*"
_BLANK = r"^[\s\x1C-\x1F\x85\p{Z}]*$"


def words(text: Column) -> Column:
    """The words of a text, parted by ASCII white space."""
    return F.array_remove(F.split(text, "[ \\t-\\r]+"), "")


def n_words(text: Column) -> Column:
    """How many words a text has."""
    return F.size(words(text))


def blank(text: Column) -> Column:
    """Whether a text is null or only spaces."""
    return F.coalesce(F.length(F.trim(text)) == 0, F.lit(True))


def sections(text: Column, aliases: dict[str, str] | None = None) -> Column:
    """Sections of a report by its upper-case headers, as an array of (name, text, start).

    What precedes the first header, its line end and space included, is the preamble;
    without a header all is the full report. Names are normal ones (``section_name``).
    Blank impressions and findings are left out; where neither is left and the last
    section holds a blank line, what follows the first such line is the last paragraph.
    Null has no sections.
    """
    whole = F.regexp_extract_all(text, F.lit(_HEADER), F.lit(0))
    marks = F.arrays_zip(whole.alias("whole"), F.regexp_extract_all(text, F.lit(_HEADER), F.lit(1)).alias("name"), F.slice(F.split(text, _HEADER), 2, F.greatest(F.size(whole), F.lit(1))).alias("gap"))
    lead = F.concat(F.element_at(F.split(text, _HEADER), 1), F.lit("\n "))
    section = lambda name, body, start: F.struct(name.alias("name"), body.alias("text"), start.cast("int").alias("start"))
    start = F.struct((F.length(lead) - 2).alias("at"), F.array(section(section_name(F.lit("preamble"), aliases), lead, F.lit(0))).alias("found"))

    def step(acc: Column, m: Column) -> Column:
        head = F.length(m["name"]) + 4
        body = F.concat(F.substring(m["whole"], head + 1, F.length(m["whole"])), F.coalesce(m["gap"], F.lit("")))
        one = section(section_name(m["name"], aliases), body, acc["at"] + head)
        return F.struct((acc["at"] + head + F.length(body)).alias("at"), F.concat(acc["found"], F.array(one)).alias("found"))

    split = F.when(F.size(whole) == 0, F.array(section(F.lit("full report"), text, F.lit(0)))).otherwise(F.aggregate(marks, start, step, lambda acc: acc["found"]))
    main = lambda s: s["name"].isin("impression", "findings")
    kept = F.transform(F.array(split), lambda found: F.filter(found, lambda s: ~(main(s) & s["text"].rlike(_BLANK))))

    def last_paragraph(found: Column) -> Column:
        last = F.element_at(found, -1)
        head = F.substring_index(last["text"], "\n \n", 1)
        tail = F.substring(last["text"], F.length(head) + 4, F.length(last["text"]))
        more = F.array(section(last["name"], head, last["start"]), section(F.lit("last_paragraph"), tail, last["start"] + F.length(head)))
        cut = ~F.exists(found, main) & F.contains(last["text"], F.lit("\n \n"))
        return F.when((F.size(found) > 0) & cut, F.concat(F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0))), more)).otherwise(found)

    return F.when(text.isNotNull(), F.element_at(F.transform(kept, last_paragraph), 1)).otherwise(F.expr(f"cast(array() as {SECTION_TYPE})"))


def section_name(name: Column, aliases: dict[str, str] | None = None) -> Column:
    """A header's normal name: by alias, then by a word it holds, then findings for a view, else unchanged."""
    table = SECTION_ALIASES if aliases is None else aliases
    out = F.lower(F.trim(name))
    ladder = F.when(F.lit(False), "")
    for word in SECTION_WORDS:
        ladder = ladder.when(F.contains(out, F.lit(word)), word)
    ladder = ladder.when(out.rlike("|".join(VIEW_WORDS)), "findings").otherwise(out)
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), out), ladder) if table else ladder


def overridden(reports: DataFrame, study: str, text: str, names: DataFrame, ranges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Studies whose section is given by hand, as ``study, name, text``, and the reports that are left for the splitter.

    ``names(study, name)`` picks the last section of that normal name; ``ranges(study,
    first, last)`` the half-open character range that is the findings.
    """
    by_range = reports.join(ranges, study).select(study, F.lit("findings").alias("name"), F.expr(f"substring({text}, first + 1, last - first)").alias("text"))
    found = reports.join(names, study).select(study, "name", F.filter(sections(F.col(text)), lambda s: s["name"] == F.col("name")).alias("__s"))
    by_name = found.select(study, "name", F.coalesce(F.try_element_at(F.col("__s"), F.lit(-1))["text"], F.lit("")).alias("text"))
    rest = reports.join(ranges.select(study).unionByName(names.select(study)), study, "left_anti")
    return by_range.unionByName(by_name), rest


def cut_at_note(text: Column, notes: tuple[str, ...] = NOTE_WORDS) -> Column:
    """A text up to its first sentence (parted by full stops) that holds a note word; empty if that is the first."""
    pattern = "|".join(re.escape(n) for n in notes)
    parts = F.split(text, r"\.")
    at = F.array_position(F.transform(parts, lambda s: s.rlike(pattern)), True)
    return F.when(at == 0, text).when(at == 1, "").otherwise(F.concat(F.array_join(F.slice(parts, 1, at.cast("int") - 1), "."), F.lit(".")))


def flat(text: Column, line_end: str = "") -> Column:
    """A text without carriage returns and tabs, its line ends replaced."""
    return F.replace(F.translate(text, "\r\t", ""), F.lit("\n"), F.lit(line_end))


def caption(text: Column) -> Column:
    """A caption trimmed, begun with a capital and ended with a full stop; null below ten characters."""
    t = F.trim(text)
    first = F.translate(F.substring(t, 1, 1), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    out = F.concat(first, F.substring(t, F.lit(2), F.length(t)))
    return F.when(F.length(t) >= 10, F.when(F.endswith(out, F.lit(".")), out).otherwise(F.concat(out, F.lit("."))))


def report(findings: Column, impression: Column) -> Column:
    """``Findings: ...`` and, if there is one, ``Impression: ...`` on the next line; findings alone stay bare."""
    return F.when(~blank(impression), F.concat(F.lit("Findings: "), findings, F.lit("\nImpression: "), impression)).otherwise(findings)


def report_part(text: Column, part: str) -> Column:
    """The findings or impression of an assembled report, trimmed; empty if it has none."""
    group = {"findings": 1, "impression": 2}[part]
    return F.trim(F.regexp_extract(text, r"(?s)^.*?Findings:(.*?)Impression:(.*)$", group))


def well_formed(text: Column) -> Column:
    """Whether a report has a findings and an impression section, neither of them blank."""
    return F.coalesce((F.length(report_part(text, "findings")) > 0) & (F.length(report_part(text, "impression")) > 0), F.lit(False))


def tags(text: Column) -> Column:
    """The marks ``[phrase](target)`` of a text in order: phrase, trimmed target, and where the phrase lies once marks are gone."""
    pattern = r"(?s)\[(.*?)\]\((.*?)\)"
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    phrase = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    target = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    gaps = F.split(text, pattern)
    marks = F.arrays_zip(whole.alias("whole"), phrase.alias("phrase"), target.alias("target"), F.slice(gaps, 1, F.size(whole)).alias("gap"))
    empty = F.expr("struct(0 as at, cast(array() as array<struct<phrase:string,target:string,start:int,end:int>>) as found)")

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + F.length(m["gap"])
        end = start + F.length(m["phrase"])
        one = F.struct(m["phrase"].alias("phrase"), F.trim(m["target"]).alias("target"), start.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.concat(acc["found"], F.array(one)).alias("found"))

    return F.aggregate(marks, empty, step, lambda acc: acc["found"])


def untagged(text: Column) -> Column:
    """A text with each ``[phrase](target)`` replaced by its phrase."""
    return F.regexp_replace(text, r"(?s)\[(.*?)\]\((.*?)\)", "$1")


def phrases(text: Column) -> Column:
    """What lies between ``<p>`` and ``</p>``, in order."""
    return F.regexp_extract_all(text, F.lit("(?s)<p>(.*?)</p>"), F.lit(1))


def paired(text: Column) -> Column:
    """Whether ``<p>`` and ``</p>`` alternate, neither nested nor stray."""
    marks = F.array_join(F.regexp_extract_all(text, F.lit("</?p>"), F.lit(0)), "")
    return F.regexp_replace(marks, "<p></p>", "") == ""


def stripped(text: Column) -> Column:
    """A text without ``<p>`` and ``</p>``."""
    return F.regexp_replace(text, "</?p>", "")


def singular(word: Column) -> Column:
    """A word without a regular English plural ending."""
    return (
        F.when(word.rlike("(?:ss|us|is)$") | (F.length(word) <= 3), word)
        .when(word.rlike("ies$"), F.regexp_replace(word, "ies$", "y"))
        .when(word.rlike("(?:ch|sh|x|z|s)es$"), F.regexp_replace(word, "es$", ""))
        .when(word.rlike("s$"), F.regexp_replace(word, "s$", ""))
        .otherwise(word)
    )


def phrase_key(text: Column) -> Column:
    """A phrase for lookups: lower case, singular words, no ``the``, single spaces."""
    return F.array_join(F.filter(F.transform(words(F.lower(text)), singular), lambda w: w != "the"), " ")


def marked(text: Column, spans: Column) -> Column:
    """A text with each span (start, end) in ``<p>`` marks; a mark takes in one space before it, but not the text's first."""
    start_of = lambda s: F.when((s["start"] > 1) & (F.substring(text, s["start"], F.lit(1)) == " "), s["start"] - 1).otherwise(s["start"])
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("made"))

    def step(acc: Column, s: Column) -> Column:
        start = start_of(s)
        made = F.concat(acc["made"], F.substring(text, acc["at"] + 1, start - acc["at"]), F.lit("<p>"), F.substring(text, start + 1, s["end"] - start), F.lit("</p>"))
        return F.struct(s["end"].alias("at"), made.alias("made"))

    ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))
    return F.aggregate(ordered, zero, step, lambda acc: F.concat(acc["made"], F.substring(text, acc["at"] + 1, F.length(text))))


def named(name: Column, positive: Column) -> Column:
    """A name in positive or negative phrase marks."""
    return F.when(positive, F.concat(F.lit("<p> "), name, F.lit("</p>"))).otherwise(F.concat(F.lit("<np> "), name, F.lit("</np>")))


def listed(names: Column) -> Column:
    """``a``, ``a and b``, ``a, b, and c``; empty for none."""
    n = F.size(names)
    return (
        F.when(n <= 1, F.array_join(names, ""))
        .when(n == 2, F.array_join(names, " and "))
        .otherwise(F.concat(F.array_join(F.slice(names, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(", and "), F.element_at(names, -1)))
    )


def results(pairs: Column) -> Column:
    """``Results: a: yes, b: no.`` of an array of (name, positive)."""
    one = lambda p: F.concat(F.lit(" "), p["name"], F.when(p["positive"], ": yes").otherwise(": no"))
    return F.concat(F.lit("Results:"), F.array_join(F.transform(pairs, one), ","), F.lit("."))


def filled(template: str, value: Column) -> Column:
    """A template with its ``{}`` filled."""
    return F.replace(F.lit(template), F.lit("{}"), value)


def score_of(text: Column) -> Column:
    """The number after ``Score:`` in a judge's answer; 0 if there is none."""
    return F.coalesce(F.regexp_extract(text, r"[Ss]core:\s*([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double"), F.lit(0.0))


def mentions(text: Column, keywords: tuple[str, ...] = HISTORY_WORDS) -> Column:
    """Whether the lower-cased text holds one of the keywords."""
    return F.lower(text).rlike("|".join(re.escape(k) for k in keywords))


def hard_cut(text: Column, has_image: Column, tag: str = "<image>") -> Column:
    """A prompt cut to 1536 characters, 1200 with an image, whose tag is appended where missing; null for an empty one."""
    cut = F.substring(text, F.lit(1), F.when(has_image, 1200).otherwise(1536))
    out = F.when(has_image & ~F.contains(cut, F.lit(tag)), F.concat(cut, F.lit(f"\n{tag}"))).otherwise(cut)
    return F.when(F.length(text) > 0, out)


def stopped(text: Column, keywords: list[str]) -> Column:
    """A text up to the first keyword it holds."""
    out = text
    for k in keywords:
        out = F.substring_index(out, k, 1)
    return out


def model_name(path: Column) -> Column:
    """The last segment of a path, led by its parent's name for a checkpoint."""
    parts = F.split(F.regexp_replace(path, "/+$", ""), "/")
    last = F.element_at(parts, -1)
    return F.when(F.startswith(last, F.lit("checkpoint-")) & (F.size(parts) > 1), F.concat_ws("_", F.try_element_at(parts, F.lit(-2)), last)).otherwise(last)


def chunks_of_words(text: Column, size: int, overlap: int = 10) -> Column:
    """Runs of ``size`` words, each repeating the last ``overlap`` of the one before."""
    def runs(w: Column) -> Column:
        n = F.greatest(F.ceil((F.size(w) - overlap) / float(size - overlap)), F.lit(1)).cast("int")
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(w, i * (size - overlap) + 1, F.lit(size)), " "))

    return F.element_at(F.transform(F.array(words(text)), runs), 1)  # the words are split once, as a bound variable


def two_numbers(text: Column) -> tuple[Column, Column]:
    """The two numbers, parted by a space, of a text's first line; null where there is none."""
    parts = F.split(F.substring_index(text, "\n", 1), " ")
    return F.try_element_at(parts, F.lit(1)).try_cast("double"), F.try_element_at(parts, F.lit(2)).try_cast("double")


def answer_of(text: Column, prompt: Column, marks: tuple[str, ...]) -> Column:
    """A generated text without the prompt it opens with and without the given control marks, trimmed."""
    out = F.when(F.startswith(text, prompt), F.substring(text, F.length(prompt) + 1, F.length(text))).otherwise(text)
    for m in marks:
        out = F.replace(out, F.lit(m), F.lit(""))
    return F.trim(out)
