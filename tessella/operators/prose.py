"""Prose: discourse, interactions, roles, coreference, scenes, arcs and conflicts over annotated text.

Annotations are tables, whoever makes them: sentences(doc_id, para, sent, text, start),
tokens(doc_id, para, sent, idx, text, lemma, pos, tag, dep, head), entities(doc_id, para, sent, text,
label, position). A text without annotations is split by plain_sentences(). What needs its rows in order
runs per document in Arrow batches; everything else is expressions and aggregations.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Connectives at the start of a sentence: relation -> "words confidence". The longest that fits counts.
_CONNECTIVES = {
    "background": "at that time 85;formerly 85;for many years 85;historically 85;historically speaking 90;in recent years 90;in the context of 80;in the past 90;initially 80;originally 85;over the years 85;previously 85;previously known as 90;since 70;traditionally 80;until recently 90;up until now 85;while 65",
    "cause": "accordingly 85;as a consequence 90;as a result 95;as a result of 95;because 90;because of this 90;consequently 90;due to the fact that 95;for that reason 90;for this reason 90;hence 85;owing to this 85;so 75;therefore 90;thus 85",
    "concession": "admittedly 85;although 90;despite this 90;even so 85;even though 95;granted 80;in any case 75;in spite of this 90;nevertheless 90;nonetheless 90;notwithstanding 85;regardless 80;still 65;though 85",
    "condition": "as long as 90;given that 85;if 85;in case 80;in the event that 90;on the condition that 95;only if 90;provided 85;provided that 95;supposing 85;unless 90",
    "contrast": "alternatively 80;at the same time 80;conversely 90;however 95;in contrast 90;in contrast to this 90;instead 80;on the other hand 95;otherwise 80;that said 80;yet 80",
    "elaboration": "additionally 90;also 75;as noted above 85;as previously mentioned 85;as well as 85;besides 80;for example 95;for instance 95;furthermore 90;in addition 90;in addition to 90;in other words 90;in particular 95;in summary 90;likewise 85;more specifically 95;moreover 90;namely 95;similarly 80;specifically 90;that is 85;that is to say 90;to be specific 90;to illustrate 85;to sum up 90",
    "evidence": "according to 85;as shown by 90;clearly 75;data shows 90;evidence suggests 95;evidently 85;indeed 80;it follows that 85;naturally 75;notably 80;obviously 75;research shows 95;studies show 95",
    "sequence": "after that 90;afterward 85;afterwards 85;as a final step 90;at this point 80;finally 90;first 85;first of all 90;following this 85;in the end 80;in the meantime 85;in turn 85;last but not least 85;lastly 90;meanwhile 85;next 80;next up 85;once 70;prior to this 85;second 85;subsequently 90;then 75;third 85;to begin with 85;to start with 85;ultimately 85",
}
CONNECTIVES: dict[str, tuple[str, float]] = {e.rsplit(" ", 1)[0]: (rel, int(e.rsplit(" ", 1)[1]) / 100) for rel, text in _CONNECTIVES.items() for e in text.split(";")}
_LONGEST = max(len(c.split()) for c in CONNECTIVES)

_VERBS = {
    "action": "attack battle bite break build carry carve catch chew chop crush cut demolish destroy dig drag draw drop fight grab hit hold kick kill lift murder place pull punch push put rip set shoot smash stab strike tear throw touch write",
    "change": "awaken bend boil burn clean close contract cool crack cure damage dissolve dry empty evaporate expand extinguish fill fix fold freeze grow harden heal heat ignite lock melt open repair shatter shrink shut soften split stain straighten stretch tie unfold unlock untie wake warm wet",
    "cognition": "assume believe conclude consider decide determine discover doubt forget imagine know learn realize recall recognize remember suppose think understand wonder",
    "communication": "announce answer argue ask call chant claim declare describe discuss explain mention murmur propose read reply report respond say shout sing speak state suggest talk whisper",
    "consumption": "consume devour dine drink eat feast gorge gulp inhale nibble sip swallow",
    "creation": "assemble bake brew compose construct cook craft create design develop establish forge found generate invent make manufacture paint prepare produce",
    "emotion": "admire appreciate desire despise dislike dread enjoy envy fear hate hope like loathe love miss need pity prefer regret respect trust want wish worry",
    "motion": "approach arrive chase climb come crawl depart drift enter escape exit fall flee float flow fly follow go hurry jump leap leave move retreat return rise roam roll run rush slide swim travel walk wander",
    "perception": "detect feel glimpse hear notice observe overhear perceive see sense smell spot taste watch witness",
    "stative": "appear be belong comprise consist constitute contain deserve endure equal exist form have include involve lack last matter mean own persist possess remain represent resemble seem signify stay",
    "transfer": "award bring buy deliver give grant hand lend offer owe pass pay present provide sell send show supply take teach tell trade",
}
VERB_CLASS = {v: c for c, vs in _VERBS.items() for v in vs.split()}
#: Who does what: class -> {dependency: role}; ":p" is the passive's.
ROLES = {
    "action": {"nsubj": "agent", "nsubj:p": "patient", "dobj": "patient", "iobj": "recipient", "agent": "agent"},
    "change": {"nsubj": "agent", "nsubj:p": "patient", "dobj": "patient", "agent": "cause"},
    "communication": {"nsubj": "agent", "dobj": "theme", "iobj": "recipient"}, "consumption": {"nsubj": "agent", "dobj": "patient"},
    "creation": {"nsubj": "agent", "dobj": "theme", "iobj": "beneficiary"}, "motion": {"nsubj": "theme", "dobj": "goal", "iobj": "goal"},
    "transfer": {"nsubj": "agent", "nsubj:p": "theme", "dobj": "theme", "iobj": "recipient", "agent": "agent"},
    **{c: {"nsubj": "experiencer", "dobj": "theme"} for c in ("cognition", "emotion", "perception", "stative")},
}
CHARACTER_LABELS = ("PERSON", "ORG", "NORP")
MOVES = frozenset(VERB_CLASS[v] == "motion" and v for v in VERB_CLASS) - {False}


def clean_markdown(text: Column) -> Column:
    """Prose of a markdown text: no front matter or fenced code; links, headings and emphasis as their words."""
    for pattern, put in (
        (r"(?s)\A---\n.*?\n---\n", ""), (r"(?ms)^```.*?^```\s*$", ""), (r"\[\[[^\]|]*\|([^\]]*)\]\]", "$1"), (r"\[\[([^\]]*)\]\]", "$1"), (r"!?\[([^\]]*)\]\([^)]*\)", "$1"),
        (r"(?m)^#{1,6}\s+", ""), (r"\*\*(.+?)\*\*", "$1"), (r"__(.+?)__", "$1"), (r"(?<!\w)[*_](\S(?:.*?\S)?)[*_](?!\w)", "$1"), (r"`([^`]*)`", "$1"),
    ):
        text = F.regexp_replace(text, pattern, put)
    return text


def paragraphs(docs: DataFrame, separator: str = "\n\n") -> DataFrame:
    """(doc_id, para, text, start): paragraphs with ink, numbered from 0; start in characters."""
    parts = F.split("text", re.escape(separator))
    each = docs.select("doc_id", F.posexplode(parts).alias("k", "text"))
    length = F.length("text") + len(separator)
    before = F.coalesce(F.sum(length).over(Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inked = each.withColumn("start", before).where(F.col("text").rlike(r"\S"))
    return inked.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("k")) - 1).alias("para"), "text", "start")


def plain_sentences(docs: DataFrame, separator: str = "\n\n", sentence: str = r"(?<=[.!?])\s+|\n") -> DataFrame:
    """(doc_id, para, sent, text) where no annotator is at hand; sent counts through the document."""
    each = paragraphs(docs, separator).select("doc_id", "para", F.posexplode(F.split("text", sentence)).alias("k", "text")).where(F.col("text").rlike(r"\S"))
    return each.select("doc_id", "para", (F.row_number().over(Window.partitionBy("doc_id").orderBy("para", "k")) - 1).alias("sent"), F.trim("text").alias("text"))


def line_of(text: Column, offset: Column) -> Column:
    """The line, from 1, of an offset in characters."""
    return F.length(F.regexp_replace(F.substring(text, F.lit(1), offset), "[^\n]", "")) + 1


def connective(text: Column) -> Column:
    """The connective that a sentence starts with, or null: the longest, ended by no letter or digit."""
    lower = F.lower(F.trim(text))
    known = F.array(*[F.lit(c) for c in CONNECTIVES])
    found = [F.regexp_extract(lower, rf"^(\w+(?: \w+){{{k - 1}}})(?![\p{{L}}\p{{N}}])", 1) for k in range(_LONGEST, 0, -1)]
    return F.coalesce(*[F.when(F.array_contains(known, f), f) for f in found])


def discourse(sentences: DataFrame) -> DataFrame:
    """(doc_id, sent, para, connective, relation, confidence, scope, nucleus, satellite): how a sentence
    hangs on the one before it."""
    w = Window.partitionBy("doc_id").orderBy("sent")
    relation = F.create_map(*[F.lit(x) for c, (r, _) in CONNECTIVES.items() for x in (c, r)])
    confidence = F.create_map(*[F.lit(x) for c, (_, p) in CONNECTIVES.items() for x in (c, p)])
    short = lambda c: F.when(F.length(c) > 40, F.concat(F.substring(c, 1, 37), F.lit("..."))).otherwise(c)
    linked = sentences.withColumns({"__text": F.lag("text").over(w), "__para": F.lag("para").over(w), "connective": connective(F.col("text"))})
    linked = linked.where("connective is not null and __text is not null")
    return linked.select(
        "doc_id", "sent", "para", "connective", F.element_at(relation, F.col("connective")).alias("relation"), F.element_at(confidence, F.col("connective")).alias("confidence"),
        F.when(F.col("para") == F.col("__para"), "intra_paragraph").otherwise("cross_paragraph").alias("scope"), short(F.col("__text")).alias("nucleus"), short(F.col("text")).alias("satellite"),
    )


def requirements(sentences: DataFrame) -> DataFrame:
    """(doc_id, sent, strength, text): shall, must and required bind, should recommends, may allows."""
    t = F.lower("text")
    strength = F.when(t.rlike(r"\b(shall|must|required)\b"), "mandatory").when(t.rlike(r"\bshould\b"), "recommended").when(t.rlike(r"\bmay\b"), "optional")
    return sentences.select("doc_id", "sent", strength.alias("strength"), "text").where("strength is not null")


def questions(sentences: DataFrame) -> DataFrame:
    """(doc_id, sent, kind, text) of sentences that end in a question mark, by their first word."""
    first = F.regexp_extract(F.lower("text"), r"^\W*(\w+)", 1)
    kind = F.when(first.isin("what", "who", "whom", "whose", "which", "where", "when", "why", "how"), first)
    kind = F.coalesce(kind, F.when(first.isin(*"is are was were do does did can could will would should may might has have had".split()), "yes_no"), F.lit("other"))
    return sentences.where(F.rtrim("text").endswith("?")).select("doc_id", "sent", kind.alias("kind"), "text")


_SPAN = ("compound", "det", "amod", "nummod", "poss", "flat")
_SVO = "doc_id string, para int, sent int, verb_idx int, verb string, lemma string, verb_class string, passive boolean, agent string, patient string, recipient string, instrument string, agent_role string, patient_role string"


def sentence_interactions(tokens: list[dict]) -> list[dict]:
    """Who does what to whom, a row a verb, in one sentence's tokens (idx, text, lemma, pos, dep, head)."""
    by_head: dict[int, list[dict]] = {}
    for t in tokens:
        if t["head"] != t["idx"]:
            by_head.setdefault(t["head"], []).append(t)

    def span(t: dict) -> str:
        return " ".join(x["text"] for x in sorted([t, *(k for k in by_head.get(t["idx"], []) if k["dep"] in _SPAN)], key=lambda x: x["idx"]))

    def joined(t: dict) -> str:
        more = [k for k in by_head.get(t["idx"], []) if k["dep"] == "conj"]
        return " and ".join([span(t), *map(span, more)])

    def below(t: dict, dep: str) -> dict | None:
        return next((k for k in by_head.get(t["idx"], []) if k["dep"] == dep), None)

    out, agents = [], {}
    for v in sorted((t for t in tokens if t["pos"] == "VERB"), key=lambda t: t["idx"]):
        r = {"verb_idx": v["idx"], "verb": v["text"], "lemma": v["lemma"].lower(), "passive": False, "agent": None, "patient": None, "recipient": None, "instrument": None}
        for k in by_head.get(v["idx"], []):
            if k["dep"] == "nsubj":
                r["agent"] = joined(k)
            elif k["dep"] == "nsubjpass":
                r["patient"], r["passive"] = joined(k), True
            elif k["dep"] in ("dobj", "obj"):
                r["patient"] = joined(k)
            elif k["dep"] in ("dative", "iobj"):
                inner = below(k, "pobj")
                r["recipient"] = joined(inner or k)
            elif k["dep"] == "agent" and (inner := below(k, "pobj")):
                r["agent"] = joined(inner)
            elif k["dep"] == "prep" and k["text"].lower() == "with" and (inner := below(k, "pobj")):
                r["instrument"] = joined(inner)
        if v["dep"] == "acl" and r["patient"] is None:
            head = next((t for t in tokens if t["idx"] == v["head"]), None)
            r["patient"] = span(head) if head else None
        if v["dep"] == "conj" and r["agent"] is None:
            r["agent"] = agents.get(v["head"])
        agents[v["idx"]] = r["agent"]
        c = VERB_CLASS.get(r["lemma"], "action")
        frame = ROLES[c]
        r["verb_class"] = c
        r["agent_role"] = frame.get("agent" if r["passive"] else "nsubj", "agent") if r["agent"] else None
        r["patient_role"] = frame.get("nsubj:p" if r["passive"] else "dobj", "theme") if r["patient"] else None
        if c == "change" and r["agent"] and not r["patient"]:
            r["agent_role"] = "patient"  # the ice melted
        if r["agent"] or r["patient"]:
            out.append(r)
    return out


def interactions(tokens: DataFrame) -> DataFrame:
    """sentence_interactions() of every sentence."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        found = sentence_interactions(g.to_dict("records"))
        rows = [{"doc_id": str(g["doc_id"].iloc[0]), "para": int(g["para"].iloc[0]), "sent": int(g["sent"].iloc[0]), **r} for r in found]
        return pd.DataFrame(rows, columns=[x.split()[0] for x in _SVO.split(", ")])

    return tokens.groupBy("doc_id", "sent").applyInPandas(run, _SVO)


def distinct_interactions(found: DataFrame) -> DataFrame:
    """(doc_id, lemma, agent, patient, times, sents): the same deed told again counts once."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return found.groupBy("doc_id", "lemma", low("agent").alias("a"), low("patient").alias("p")).agg(
        F.min_by("agent", "sent").alias("agent"), F.min_by("patient", "sent").alias("patient"), F.count("*").alias("times"), F.sort_array(F.collect_set("sent")).alias("sents")
    ).drop("a", "p")


def distinct_entities(entities: DataFrame) -> DataFrame:
    """(doc_id, name, label, mentions, sents): entities by lower-cased name and label."""
    return entities.groupBy("doc_id", F.lower("text").alias("key"), "label").agg(F.min_by("text", F.struct("sent", "text")).alias("name"), F.count("*").alias("mentions"), F.sort_array(F.collect_set("sent")).alias("sents")).drop("key")


def characters(entities: DataFrame) -> DataFrame:
    """Entities that act: persons, groups, organisations, and places that share a name with a person."""
    people = entities.where("label = 'PERSON'").select("doc_id", F.lower("text").alias("__n")).distinct().withColumn("__p", F.lit(True))
    out = entities.join(people, (entities.doc_id == people.doc_id) & (F.lower(entities.text) == people["__n"]), "left")
    return out.where(F.col("label").isin(*CHARACTER_LABELS) | (F.col("label").isin("GPE", "LOC") & F.coalesce("__p", F.lit(False)))).select(entities["*"])


_HE, _SHE, _IT, _THEY = {"he", "him", "his", "himself"}, {"she", "her", "hers", "herself"}, {"it", "its", "itself"}, {"they", "them", "their", "theirs", "themselves"}
_LINKS = "doc_id string, sent int, pronoun string, canonical string, confidence double, method string"


def pronoun_class(word: str) -> str | None:
    w = word.lower()
    return "he" if w in _HE else "she" if w in _SHE else "it" if w in _IT else "they" if w in _THEY else None


def resolve_pronouns(sentences: list[list[dict]], paras: list[int]) -> list[tuple]:
    """(sentence, pronoun, whom, confidence, method). Each sentence is its mentions in order: {text, label,
    idx, dep} for entities, with label None for pronouns. Earlier mentions of the sentence come first
    (0.90 alone, else the nearest 0.65), then those of the sentence before in the same paragraph (0.80
    alone, 0.65 its subject, else the last 0.50), then the paragraph's topic (0.70). What a name was
    called once it stays: a name taken for he is not taken for she."""
    out, gender, topic = [], {}, None

    def fits(p: str, e: dict) -> bool:
        people = e["label"] in ("PERSON", "NORP")
        if p in ("he", "she"):
            return people and gender.get(e["text"].lower(), p) == p
        return not people if p == "it" else people or e["label"] == "ORG"

    for i, mentions in enumerate(sentences):
        if i and paras[i] != paras[i - 1]:
            topic = None
        for m in mentions:
            p = pronoun_class(m["text"]) if m["label"] is None else None
            if p is None:
                continue
            reflexive = m["text"].lower().endswith(("self", "selves"))
            if p == "it" and m.get("dep") == "expl":
                continue
            before = [e for e in mentions if e["label"] and e["idx"] < m["idx"] and fits(p, e)]
            hit = None
            if before:
                hit = (before[-1], 0.90 if len({e["text"].lower() for e in before}) == 1 else 0.65, "same_sentence")
            elif not reflexive and i and paras[i] == paras[i - 1]:
                prior = [e for e in sentences[i - 1] if e["label"] and fits(p, e)]
                if prior:
                    subject = next((e for e in prior if e.get("dep") in ("nsubj", "nsubjpass")), None)
                    alone = len({e["text"].lower() for e in prior}) == 1
                    hit = (prior[-1], 0.80, "previous_sentence") if alone else (subject, 0.65, "previous_subject") if subject else (prior[-1], 0.50, "previous_last")
                elif topic and fits(p, topic):
                    hit = (topic, 0.70, "topic")
            if hit:
                if p in ("he", "she"):
                    gender.setdefault(hit[0]["text"].lower(), p)
                out.append((i, m["text"], hit[0]["text"], hit[1], hit[2]))
        topic = next((e for e in mentions if e["label"] and e.get("dep") in ("nsubj", "nsubjpass")), topic)
    return out


def coreference(mentions: DataFrame) -> DataFrame:
    """Pronouns with whom they mean, over (doc_id, para, sent, idx, text, label, dep)."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["sent", "idx"])
        sents = sorted(g["sent"].unique())
        rows = [[{**m, "label": m["label"] if isinstance(m["label"], str) else None} for m in g[g["sent"] == s].to_dict("records")] for s in sents]
        paras = [int(g[g["sent"] == s]["para"].iloc[0]) for s in sents]
        found = [(str(g["doc_id"].iloc[0]), int(sents[i]), *r) for i, *r in resolve_pronouns(rows, paras)]
        return pd.DataFrame(found, columns=[x.split()[0] for x in _LINKS.split(", ")])

    return mentions.groupBy("doc_id").applyInPandas(run, _LINKS)


def chains(links: DataFrame) -> DataFrame:
    """(doc_id, canonical, mentions, confidence) by lower-cased name."""
    return links.groupBy("doc_id", F.lower("canonical").alias("k")).agg(F.min("canonical").alias("canonical"), F.count("*").alias("mentions"), F.round(F.avg("confidence"), 4).alias("confidence")).drop("k")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.when(both > 0, both))


def find_scenes(paras: list[dict], breaks: set[int]) -> list[dict]:
    """Scenes of paragraphs {names, places, times} in order; breaks holds those a background or sequence
    relation leads into. A new place begins a scene, as do two of: a time, other people (Jaccard below
    0.15 with the scene so far), such a relation."""
    if not paras:
        return []
    if len(paras) > 1 and not any(p["names"] for p in paras):
        return [{"start": i, "end": i, "names": [], "place": None, "signals": ["paragraph_break"] * bool(i)} for i in range(len(paras))]
    starts, names, places = [(0, [])], set(paras[0]["names"]), set(paras[0]["places"])
    for i, p in enumerate(paras[1:], 1):
        n = set(p["names"])
        union = names | n
        signals = ["location_change"] * bool(set(p["places"]) - places) + ["temporal_marker"] * bool(p["times"])
        signals += ["entity_shift"] * bool(union and len(names & n) / len(union) < 0.15) + ["discourse_break"] * (i in breaks)
        if "location_change" in signals or len(signals) > 1:
            starts.append((i, signals))
            names, places = n, set(p["places"])
        else:
            names, places = union, places | set(p["places"])
    out = []
    for (s, signals), e in zip(starts, [s for s, _ in starts[1:]] + [len(paras)]):
        here = Counter(x for p in paras[s:e] for x in p["places"])
        place = min(here, key=lambda x: (-here[x], x)) if here else None
        out.append({"start": s, "end": e - 1, "names": sorted({x for p in paras[s:e] for x in p["names"]}), "place": place, "signals": signals})
    return out


_SCENES = "doc_id string, scene int, start_para int, end_para int, place string, names array<string>, signals array<string>"


_SCENES_ARROW = pa.schema([(n, {"int": pa.int32(), "string": pa.string()}.get(t, pa.list_(pa.string()))) for n, t in (x.split() for x in _SCENES.split(", "))])


def _scenes(batches: Iterable[pa.RecordBatch], size: int = 1024) -> Iterator[pa.RecordBatch]:
    """Scenes of paragraphs sorted by document; one document is held at a time."""
    rows = (r for b in batches for k in range(0, b.num_rows, 1024) for r in b.slice(k, 1024).to_pylist())
    out: list[tuple] = []
    for doc_id, own in groupby(rows, key=lambda r: r["doc_id"]):
        paras = [{"para": r["para"], "b": r["__b"]} | {k: r[k] or [] for k in ("names", "places", "times")} for r in own]
        found = find_scenes(paras, {i for i, p in enumerate(paras) if p["b"] is True})
        out += [(str(doc_id), i, paras[s["start"]]["para"], paras[s["end"]]["para"], s["place"], s["names"], s["signals"]) for i, s in enumerate(found)]
        for k in range(0, len(out) - len(out) % size, size):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[k : k + size]), _SCENES_ARROW)], schema=_SCENES_ARROW)
        del out[: len(out) - len(out) % size]
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SCENES_ARROW)], schema=_SCENES_ARROW)


def scenes(paras: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """Scenes of (doc_id, para, names, places, times), with discourse() of the same documents."""
    if relations is not None:
        breaks = relations.where("scope = 'cross_paragraph' and relation in ('background', 'sequence')").select("doc_id", "para").distinct().withColumn("__b", F.lit(True))
        paras = paras.join(breaks, ["doc_id", "para"], "left")
    else:
        paras = paras.withColumn("__b", F.lit(False))

    # by a hash, as the text of an id stands for it; documents are many and short, so a task takes its own in one stream
    placed = paras.select("doc_id", "para", "names", "places", "times", "__b").repartition(F.xxhash64("doc_id")).sortWithinPartitions("doc_id", F.asc_nulls_last("para"))
    return placed.mapInArrow(_scenes, _SCENES)


def arcs(events: DataFrame) -> DataFrame:
    """(doc_id, name, total, peak, shape, confidence) over (doc_id, name, position 0..1, role).

    The peak is the upper median of positions. Another main role in the second half makes the arc
    transformative; else rising, falling or peak where a third has 1.5 times the others, else flat."""
    third = lambda a, b: F.count(F.when((F.col("position") >= a) & (F.col("position") < b), 1))
    n = events.groupBy("doc_id", "name").agg(F.count("*").alias("total"), F.sort_array(F.collect_list("position")).alias("p"), third(0, 0.33).alias("b"), third(0.33, 0.67).alias("m"), third(0.67, 1.01).alias("e"))
    half = events.where("role is not null").groupBy("doc_id", "name", "role").agg(F.count(F.when(F.col("position") < 0.5, 1)).alias("h1"), F.count(F.when(F.col("position") >= 0.5, 1)).alias("h2"))
    top = lambda c: F.max(F.when(F.col(c) > 0, F.struct(F.col(c).alias("n"), "role")))["role"]
    roles = half.groupBy("doc_id", "name").agg(top("h1").alias("r1"), top("h2").alias("r2"))
    ratio = lambda a, b: F.when(b > 0, a / F.when(b > 0, b)).otherwise(3.0)
    b, m, e = F.col("b"), F.col("m"), F.col("e")
    rising, falling, peak = (e > b * 1.5) & (e > m), (b > e * 1.5) & (b > m), (m > b * 1.5) & (m > e * 1.5)
    shifted = F.coalesce(F.col("r1") != F.col("r2"), F.lit(False))
    sure = lambda r: F.least(F.lit(0.6) + F.least(r - 1.5, F.lit(2.0)) * 0.1, F.lit(0.95))
    shape = F.when(F.col("total") < 2, "flat").when(shifted, "transformative").when(rising, "rising").when(falling, "falling").when(peak, "peak").otherwise("flat")
    confidence = F.when(F.col("total") < 2, 0.40).when(shifted, 0.75).when(rising, sure(ratio(e, b))).when(falling, sure(ratio(b, e))).when(peak, 0.80).otherwise(0.60)
    out = n.join(roles, ["doc_id", "name"], "left")
    return out.select("doc_id", "name", "total", F.element_at("p", F.expr("int(size(p) div 2) + 1")).alias("peak"), shape.alias("shape"), F.round(confidence, 4).alias("confidence"))


def conflicts(deeds: DataFrame) -> DataFrame:
    """(doc_id, a, b, times, verbs, trend) of pairs in either order over (doc_id, agent, patient, lemma,
    position), without pronouns: up to five verbs by position; brief under 3 times, resolving if nothing
    comes after 0.8, escalating if the second half has more, else stable."""
    pronouns = [*_HE, *_SHE, *_IT, *_THEY, "i", "me", "we", "us", "you"]
    a, b = F.lower("agent"), F.lower("patient")
    pairs = deeds.where("agent is not null and patient is not null").where(~a.isin(*pronouns) & ~b.isin(*pronouns) & (a != b))
    pairs = pairs.select("doc_id", F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), "lemma", "position")
    first = pairs.groupBy("doc_id", "a", "b", "lemma").agg(F.min("position").alias("at"), F.count("*").alias("n"), F.max("position").alias("last"), F.count(F.when(F.col("position") < 0.5, 1)).alias("h1"))
    out = first.groupBy("doc_id", "a", "b").agg(F.sum("n").alias("times"), F.array_sort(F.collect_list(F.struct("at", "lemma"))).alias("v"), F.max("last").alias("last"), F.sum("h1").alias("h1"))
    trend = F.when(F.col("times") < 3, "brief").when(F.col("last") < 0.8, "resolving").when(F.col("times") - F.col("h1") > F.col("h1"), "escalating").otherwise("stable")
    return out.select("doc_id", "a", "b", "times", F.slice(F.transform("v", lambda x: x["lemma"]), 1, 5).alias("verbs"), trend.alias("trend"))


def foreshadowing(mentions: DataFrame) -> DataFrame:
    """(doc_id, name, early, late): at most twice in the first half and four times or more in the second."""
    n = mentions.groupBy("doc_id", "name").agg(F.count(F.when(F.col("position") < 0.5, 1)).alias("early"), F.count(F.when(F.col("position") >= 0.5, 1)).alias("late"))
    return n.where("early between 1 and 2 and late >= 4")


def setups_without_payoff(arcs_: DataFrame, conflicts_: DataFrame) -> DataFrame:
    """(doc_id, name, issue): who falls away though in a conflict that isn't resolved, or peaks without any."""
    ends = conflicts_.select("doc_id", F.explode(F.array("a", "b")).alias("k"), "trend")
    open_ = ends.groupBy("doc_id", "k").agg(F.max(F.col("trend").isin("escalating", "stable")).alias("open"))
    out = arcs_.join(open_, (arcs_.doc_id == open_.doc_id) & (F.lower(arcs_.name) == open_.k), "left").select(arcs_["*"], "open")
    issue = F.when((F.col("shape") == "falling") & F.col("open"), "dropped_conflict").when((F.col("shape") == "peak") & F.col("open").isNull(), "peak_without_conflict")
    return out.select("doc_id", "name", issue.alias("issue")).where("issue is not null")


def consistency(scenes_: DataFrame, deeds: DataFrame) -> DataFrame:
    """(doc_id, scene, from_place, to_place): the place changes and no verb of motion tells how."""
    w = Window.partitionBy("doc_id").orderBy("scene")
    moved = scenes_.withColumn("from_place", F.lag("place").over(w)).where("place is not null and from_place is not null and place <> from_place")
    motion = deeds.where(F.col("lemma").isin(*sorted(MOVES))).select(F.col("doc_id").alias("d"), F.col("para").alias("p")).distinct()
    out = moved.join(motion, (moved.doc_id == motion.d) & F.col("p").between(moved.start_para, moved.end_para), "left_anti")
    return out.select("doc_id", "scene", "from_place", F.col("place").alias("to_place"))


def statistics(sentences: DataFrame) -> DataFrame:
    """(doc_id, paragraphs, sentences, words)."""
    words = F.size(F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    return sentences.groupBy("doc_id").agg(F.count_distinct("para").alias("paragraphs"), F.count("*").alias("sentences"), F.sum(words).alias("words"))


def corpus_offsets(files: DataFrame) -> DataFrame:
    """(file, ord, line_offset, para_lo, para_hi) of (file, ord, lines, paras): where each file stands in all."""
    w = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0))
    return files.select("file", "ord", before("lines").alias("line_offset"), before("paras").alias("para_lo"), (before("paras") + F.col("paras")).alias("para_hi"))


def merge_entities(entities: DataFrame) -> DataFrame:
    """(name, labels, files, mentions) over all documents, by lower-cased name whatever the label."""
    return entities.groupBy(F.lower("text").alias("k")).agg(F.min("text").alias("name"), F.sort_array(F.collect_set("label")).alias("labels"), F.count_distinct("doc_id").alias("files"), F.count("*").alias("mentions")).drop("k")


_OBLIQUES = {"at": "location", "by": "agent", "for": "beneficiary", "from": "source", "in": "location", "into": "goal", "on": "location", "onto": "goal", "to": "goal", "with": "instrument"}
_SIDE = "doc_id string, sent int, idx int, kind string, word string, text string, of string, confidence double"


def sentence_sides(tokens: list[dict]) -> list[dict]:
    """What stands beside a sentence's names and verbs: an apposition is another name of its head (0.95);
    the object of a verb's preposition has the role that the preposition gives (0.80)."""
    by_idx = {t["idx"]: t for t in tokens}

    def span(t: dict) -> str:
        return " ".join(x["text"] for x in tokens if x["idx"] == t["idx"] or (x["head"] == t["idx"] and x["dep"] in _SPAN))

    out = []
    for t in tokens:
        head = by_idx.get(t["head"])
        if head is None or head is t:
            continue
        if t["dep"] == "appos":
            out.append({"idx": t["idx"], "kind": "alias", "word": None, "text": span(t), "of": span(head), "confidence": 0.95})
        elif t["dep"] == "pobj" and head["dep"] == "prep" and (verb := by_idx.get(head["head"])) and verb["pos"] == "VERB" and head["text"].lower() in _OBLIQUES:
            out.append({"idx": t["idx"], "kind": _OBLIQUES[head["text"].lower()], "word": head["text"].lower(), "text": span(t), "of": verb["lemma"].lower(), "confidence": 0.80})
    return out


def sides(tokens: DataFrame) -> DataFrame:
    """sentence_sides() of every sentence."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("idx")
        rows = [{"doc_id": str(g["doc_id"].iloc[0]), "sent": int(g["sent"].iloc[0]), **r} for r in sentence_sides(g.to_dict("records"))]
        return pd.DataFrame(rows, columns=[x.split()[0] for x in _SIDE.split(", ")])

    return tokens.groupBy("doc_id", "sent").applyInPandas(run, _SIDE)
