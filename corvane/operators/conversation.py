"""Conversations: records from studies, chat styles, judge prompts, token masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import filled, listed, marked
from corvane.operators.sampling import choice, toss

# Separators of the chat styles (between turns, after an answer).
STYLES = {"single": ("###", "###"), "two": (" ", "</s>"), "mpt": ("<|im_end|>\n", "<|im_end|>\n"), "plain": ("\n", "\n")}


def rendered(turns: Column, style: str) -> Column:
    """An array of (role, text) in order, in one of the chat styles; a blank last text leaves only its role."""
    if style in ("llama_2", "mistral"):
        first = "<s>" if style == "llama_2" else ""
        system = F.try_element_at(F.filter(turns, lambda t: t["role"] == "system"), F.lit(1))["text"]
        head = F.when(system.isNotNull(), F.concat(F.lit("<<SYS>>\n"), system, F.lit("\n<</SYS>>\n\n"))).otherwise("")
        rest = F.filter(turns, lambda t: t["role"] != "system")
        one = lambda t, i: F.when(t["role"] == "user", F.concat(F.lit(f"{first}[INST] "), F.when(i == 0, head).otherwise(""), t["text"], F.lit(" [/INST]"))).otherwise(F.concat(F.lit(" "), t["text"], F.lit(" </s>")))
        return F.array_join(F.transform(rest, one), "")
    between, after = STYLES[style]
    if style == "plain":
        return F.array_join(F.transform(turns, lambda t, i: F.concat(t["text"], F.lit(between))), "")
    name = (lambda t: F.concat(F.lit("<|im_start|>"), t["role"], F.lit("\n"))) if style == "mpt" else (lambda t: F.concat(t["role"], F.lit(":")))
    space = "" if style == "mpt" else " "

    def one(t: Column, i: Column) -> Column:
        end = F.when(t["role"] == "assistant", F.lit(after)).otherwise(F.lit(between))
        return F.when(F.length(t["text"]) > 0, F.concat(name(t), F.lit(space), t["text"], end)).otherwise(name(t))

    return F.array_join(F.transform(turns, one), "")


def study_conversation(modalities: Column, planes: Column, report: Column, vqa: Column, seed: int, key: Column, p: float = 0.2) -> Column:
    """Turns of a study record as (prompt, response): now and then modality and plane, then the report or its questions.

    Modality is forced where nothing else is left; choices come from the seed and the key.
    """
    turn = lambda q, a: F.struct(q.alias("prompt"), a.alias("response"))
    modality = turn(F.lit("What is the modality of the images?"), F.concat(listed(F.array_distinct(modalities)), F.lit(".")))
    plane = turn(F.lit("What is the plane of the images?"), F.concat(listed(F.array_distinct(F.array_compact(planes))), F.lit(".")))
    asks = F.transform(vqa, lambda v: turn(v["question"], v["answer"]))
    has_vqa, has_report = F.coalesce(F.size(vqa) > 0, F.lit(False)), F.coalesce(F.length(report) > 0, F.lit(False))
    take_report = has_report & ~(has_vqa & toss(0.8, f"{seed}-report", key))
    prompts = F.array(F.lit("Write a report of the images."), F.lit("Describe the findings."), F.lit("Report on this study."))
    main = F.when(take_report, F.array(turn(choice(prompts, f"{seed}-prompt", key), report))).when(has_vqa, asks)
    none = F.slice(F.array(modality), 1, 0)
    body = F.coalesce(main, none)
    lead = F.concat(
        F.when((F.size(modalities) > 0) & (toss(p, f"{seed}-modality", key) | (F.size(body) == 0)), F.array(modality)).otherwise(none),
        F.when((F.size(F.array_compact(planes)) > 0) & toss(p, f"{seed}-plane", key), F.array(plane)).otherwise(none),
    )
    return F.concat(lead, body)


def chosen_image(images: Column, planes: Column, frontal_only: Column, seed: int, key: Column, p: float = 0.9) -> Column:
    """The image of a record and whether a report may be asked of it: ``struct<image, place, report>``.

    Where ``frontal_only``: if all are frontal (PA or AP), or some are and a toss of ``p``
    says so, one of those; else one of the others, and no report. Elsewhere any image.
    """
    places = F.transform(planes, lambda x, i: F.struct(F.coalesce(x.isin("PA", "AP"), F.lit(False)).alias("front"), i.alias("at")))
    pick = lambda wanted: F.transform(F.filter(places, lambda x: x["front"] == wanted), lambda x: x["at"])
    front, side = pick(F.lit(True)), pick(F.lit(False))
    report = ~frontal_only | (F.size(side) == 0) | ((F.size(front) > 0) & toss(p, f"{seed}-front", key))
    pool = F.when(~frontal_only, F.transform(images, lambda x, i: i)).when(report, front).otherwise(side)
    at = choice(pool, f"{seed}-image", key)
    return F.struct(F.get(images, at).alias("image"), at.alias("place"), report.alias("report"))


def report_image(images: Column, planes: Column, wanted: tuple[str, ...] | None = ("AP", "PA")) -> Column:
    """The one image that a report is learnt from: the first of a wanted plane, the first of all where none is named; null without one."""
    if wanted is None:
        return F.get(images, F.lit(0))
    fit = F.filter(F.arrays_zip(images.alias("image"), planes.alias("plane")), lambda x: x["plane"].isin(*wanted))
    return F.get(fit, F.lit(0))["image"]


def single_images(df: DataFrame, images: str) -> DataFrame:
    """``df``, after a check that every record has one image."""
    if not df.where(F.coalesce(F.size(images), F.lit(0)) != 1).isEmpty():
        raise ValueError(f"a record's {images} aren't one")
    return df


def split_anomaly(positive: Column, whole: str, parts: list[str], seed: int, key: Column, p: float = 0.9) -> Column:
    """Anomaly names where, by a toss of ``p``, ``whole`` stands for its parts, and otherwise the parts for it."""
    without = F.filter(positive, lambda n: ~n.isin(whole, *parts))
    named = F.exists(positive, lambda n: n.isin(whole, *parts))
    own = F.filter(positive, lambda n: n.isin(*parts))
    return F.when(~named, positive).when(toss(p, f"{seed}-whole", key) | (F.size(own) == 0), F.concat(F.array(F.lit(whole)), without)).otherwise(F.concat(own, without))


def grounded_turn(report: Column, tags: Column, available: Column, prompt: Column) -> tuple[Column, Column]:
    """The report with its tags in phrase marks as (prompt, response), and of each tag whether its target has a mask."""
    return F.struct(prompt.alias("prompt"), marked(report, tags).alias("response")), F.transform(tags, lambda t: F.array_contains(available, t["target"]))


def anomaly_turn(positive: Column, name: str = "Which anomalies can be seen?") -> Column:
    """A question for anomalies and its listed answer, or that there are none."""
    return F.struct(F.lit(name).alias("prompt"), F.when(F.size(positive) > 0, F.concat(listed(positive), F.lit("."))).otherwise("No anomaly.").alias("response"))


def yes_no_turn(names: Column, positive: Column, seed: int, key: Column) -> Column:
    """A question over mixed names in seeded order, and its yes/no list."""
    order = F.array_sort(F.transform(names, lambda n: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"), n)).alias("h"), n.alias("n"))))
    mixed = F.transform(order, lambda x: x["n"])
    said = F.transform(mixed, lambda n: F.concat(F.lit(" "), n, F.when(F.array_contains(positive, n), ": yes").otherwise(": no")))
    return F.struct(filled("Are these present: {}?", F.array_join(mixed, ", ")).alias("prompt"), F.concat(F.lit("Results:"), F.array_join(said, ","), F.lit(".")).alias("response"))


def sampled_names(targets: Column, category: str, limit: int, seed: int | str, key: Column) -> Column:
    """The names of one category of ``targets`` (``name, category``), at most ``limit``, in seeded order."""
    own = F.filter(targets, lambda t: t["category"] == category)
    keyed = F.array_sort(F.transform(own, lambda t: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"), t["name"])).alias("h"), t["name"].alias("n"))))
    return F.slice(F.transform(keyed, lambda x: x["n"]), 1, limit)


def local_record(positive: Column, negative: Column, modalities: Column, seed: int, key: Column, most_positive: int = 4, most_negative: int = 4, p_modality: float = 0.8, p_grounding: float = 0.99, p_negative: float = 0.2) -> Column:
    """A record of one annotated image: ``modality, turns (prompt, response), classes (name, positive), grounding, negative_grounding``.

    ``positive`` and ``negative`` are targets (``name, category``) with category ``anatomy``
    or ``anomaly``. Of each kind and category a seeded sample up to its limit is taken. Anatomy
    gives a yes/no turn over both samples, if any; anomaly a turn that names what is there,
    if any target of it was annotated at all. The turn of the modality comes first by a
    toss, and always where there is no other. ``classes`` are those to be grounded, in the
    order of the turns: what was found, and by a toss, made only where the record is grounded
    at all, also what wasn't. All draws follow from seed and key, so a record is the same
    wherever and however often it is built.
    """
    take = lambda side, targets, category, limit: sampled_names(targets, category, limit, f"{seed}-{side}-{category}", key)
    has, lacks = {}, {}
    for category in ("anatomy", "anomaly"):
        has[category], lacks[category] = take("pos", positive, category, most_positive), take("neg", negative, category, most_negative)
    grounding = toss(p_grounding, f"{seed}-ground", key)
    also = grounding & toss(p_negative, f"{seed}-negative", key)
    modality = choice(modalities, f"{seed}-modality", key)
    turn = lambda q, a: F.struct(q.alias("prompt"), a.alias("response"))
    first = F.array(turn(F.lit("What is the modality of the image?"), F.concat(modality, F.lit("."))))
    none = F.slice(first, 1, 0)
    any_of = lambda c: F.size(has[c]) + F.size(lacks[c]) > 0
    anatomy = F.when(any_of("anatomy"), F.array(yes_no_turn(F.concat(has["anatomy"], lacks["anatomy"]), has["anatomy"], seed, key))).otherwise(none)
    anomaly = F.when(any_of("anomaly"), F.array(anomaly_turn(has["anomaly"]))).otherwise(none)
    body = F.concat(anatomy, anomaly)
    lead = F.when((F.size(body) == 0) | toss(p_modality, f"{seed}-lead", key), first).otherwise(none)
    named = lambda names, found: F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(found).alias("positive")))
    empty = F.expr("cast(array() as array<struct<name: string, positive: boolean>>)")
    classes = F.when(grounding, F.concat(*(F.concat(named(has[c], True), F.when(also, named(lacks[c], False)).otherwise(empty)) for c in ("anatomy", "anomaly")))).otherwise(empty)
    return F.struct(modality.alias("modality"), F.concat(lead, body).alias("turns"), classes.alias("classes"), grounding.alias("grounding"), also.alias("negative_grounding"))


def few_shot(system: str, examples: list[tuple[str, str]], question: Column) -> Column:
    """A chat: system, worked examples, and the question."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("text"))
    shots = [message(role, F.lit(t)) for pair in examples for role, t in zip(("user", "assistant"), pair, strict=True)]
    return F.array(message("system", F.lit(system)), *shots, message("user", question))


def question_text(vqa: Column, seed: int, key: Column, first_only: bool = False) -> Column:
    """``Question: q Answer: a`` of all pairs in seeded order, or of the first alone."""
    order = F.array_sort(F.transform(vqa, lambda v: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"), v["question"])).alias("h"), v["question"].alias("q"), v["answer"].alias("a"))))
    said = F.transform(F.slice(order, 1, 1) if first_only else order, lambda x: F.concat(F.lit("Question: "), x["q"], F.lit(" Answer: "), x["a"]))
    return F.array_join(said, " ")


def judge_prompt(question: Column, a: Column, b: Column, rule: str) -> Column:
    """A prompt that has a judge compare two answers."""
    return F.concat(F.lit("[Question]\n"), question, F.lit("\n\n[Assistant 1]\n"), a, F.lit("\n\n[Assistant 2]\n"), b, F.lit(f"\n\n[System]\n{rule}"))


def with_image_ids(text: Column, encode, image_id: int) -> Column:
    """Ids of a prompt's parts with the image id where ``<image>`` stood; ``encode`` maps a string column to ids."""
    parts = F.split(text, "<image>")
    return F.flatten(F.transform(parts, lambda p, i: F.when(i == 0, encode(p)).otherwise(F.concat(F.array(F.lit(image_id)), encode(p)))))


def masked_labels(prompt: Column, answer: Column, eos: int, most: int, ignore: int = -100) -> tuple[Column, Column]:
    """Input ids and labels of a prompt and its answer: the prompt is ignored, the end is learnt, both are cut at ``most``."""
    ids = F.concat(prompt, answer, F.array(F.lit(eos)))
    labels = F.concat(F.array_repeat(F.lit(ignore), F.size(prompt)), answer, F.array(F.lit(eos)))
    return F.slice(ids, 1, most), F.slice(labels, 1, most)


def padded(values: Column, size: Column, pad: int) -> Column:
    """An array filled up to ``size``."""
    return F.concat(values, F.array_repeat(F.lit(pad).cast("long"), F.greatest(size - F.size(values), F.lit(0)).cast("int")))


def position_ids(tokens: Column, opening: int, closing: int) -> Column:
    """Position of each token; it doesn't move on after an opening mark, nor at a closing one."""
    start = F.struct(F.lit(-1).alias("at"), F.lit(False).alias("held"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        at = F.when(acc["held"] | (t == closing), acc["at"]).otherwise(acc["at"] + 1)
        return F.struct(at.alias("at"), (t == opening).alias("held"), F.concat(acc["out"], F.array(at)).alias("out"))

    return F.aggregate(tokens, start, step, lambda acc: acc["out"])


def kept_spans(tokens: Column, closing: int, flags: Column) -> Column:
    """Flags of the marked spans that a truncated token list still closes."""
    return F.slice(flags, 1, F.size(F.filter(tokens, lambda t: t == closing)))


def chunked(values: Column, size: int) -> Column:
    """Runs of ``size`` elements with their half-open bounds."""
    n = F.ceil(F.size(values) / float(size)).cast("int")
    part = lambda i: F.struct((i * size).alias("start"), F.least((i + 1) * size, F.size(values)).alias("end"), F.slice(values, i * size + 1, F.lit(size)).alias("part"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), part)).otherwise(F.slice(F.transform(F.sequence(F.lit(0), F.lit(0)), part), 1, 0))
