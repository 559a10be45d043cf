"""Free-typed values to a canonical list: token repair, then soft TF-IDF over entries.

Only distinct values are worked on. Each is freed of decoration and read as a head and a
remark (what follows a semicolon, comma, bracket, dash or counter); head, remark and both
together are phrases, cut into tokens (a whole phrase without blanks is one more token, for
damaged blanks). Distinct tokens meet the tokens of the reference list in an equi-join on
deletion variants - two words within two edits share a variant with at most two letters
taken from each - and are kept within the edits their length allows (insertion, deletion,
substitution, swap of neighbours). Repaired tokens are combined with soft TF-IDF into a
score per entry; the best entry of the field wins if it is good enough.

Nothing of a value is passed over: the head decides, a remark that means another entry is a
conflict, and where the head alone means nothing head and remark are read as one phrase.

Defined results: null and blank values give no row; ``value_id`` is 0 for a conflict, a
head with a negation, a remark that is nothing but one, a value that is itself an entry of
another field only, and anything below the score. Ties go to the entry with the smallest
``value_id``. Texts of any length are read whole. Repeated rows repeat; other columns are
not looked at; an empty reference list maps everything to 0.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from quillgraph.plans.skew import lookup_join
from quillgraph.session import stored

# What people also write for the listed meanings, in English, German, French
# and Spanish. A lexicon is a parameter of the operator; this is its default.
LEXICON = {
    "status": {
        "inbox": "untriaged;not looked at yet;unsorted;new;neu;eingang;nouveau;nuevo;to do;zu erledigen;offen;ouvert;abierto",
        "ready": "good to go;bereit;pret;listo;can start;startklar",
        "queued": "next in line;waiting its turn;in der warteschlange;en attente;en cola;eingereiht;lined up next;up next",
        "in_progress": "underway;working on it;in arbeit;en cours;en curso;under way;ongoing;in work;being worked on;laufend",
        "merge_ready": "can be merged now;ready to merge;bereit zum zusammenfuhren;waits for merge;pret a fusionner;good to merge",
        "review": "being looked over;under review;under scrutiny;in prufung;en revision;in review;being reviewed;en relecture",
        "done": "finished;all finished;wrapped up;erledigt;termine;hecho;terminado;fertig;fini;abgeschlossen",
        "blocked": "stuck;blockiert;bloque;bloqueado;held up;waiting on others",
        "paused": "parked;taking a break;pausiert;en pause;en pausa;put aside;resting",
        "someday": "one fine day;irgendwann;un jour;algun dia;some day;one day",
        "cancelled": "called off;abgebrochen;annule;cancelado;abandoned;storniert;given up;scrapped",
        "partial": "only some of it;half done;teilweise;partiel;parcial;in part;partly done;partially done",
    },
    "doc_type": {
        "task": "to do;aufgabe;tache;tarea;job;errand",
        "epic": "big project;umbrella project;grossprojekt;grand projet;epopee;gran proyecto",
        "goal": "ambition;ziel;but;objectif;objetivo;meta",
        "target": "zielwert;cible;measurable goal;kennzahl;benchmark",
        "memory": "erinnerung;souvenir;recuerdo;reminiscence",
        "note": "scribble;notiz;nota;remark",
        "prototype": "blueprint;prototyp;muster;prototipo;exemplar",
        "reference": "source material;nachschlagewerk;referenz;referencia;lookup material;ouvrage de reference",
        "review": "appraisal;gutachten;critica;evaluation;rezension",
        "spec": "requirements;pflichtenheft;cahier des charges;especificacion;spezifikation",
        "case": "akte;affaire;caso;case file;fall",
        "daily": "tagebuch;journal du jour;diario;todays page;tagesseite;diary",
        "session-log": "minutes of the session;sitzungsprotokoll;proces verbal;acta;session notes;protokoll",
        "audit-report": "prufbericht;rapport d audit;informe de auditoria;what the auditors found;auditors report",
        "template": "vorlage;blank form;modele;plantilla;fill in form",
        "contact": "phone book entry;kontakt;contacto;ansprechpartner;business card",
    },
}

# Words that turn a value into its opposite, stand-ins for "nothing known",
# and what is written before a value to say of which field it is.
NEGATIONS = "not no non never isnt nicht kein keine pas sans ni sin nunca".split()
STAND_INS = "nothing nobody nichts null none nil na nan tbd unknown".split()
LABELS = "status state type doctype kind".split()

# Letters of other scripts and accented letters that look like Latin ones.
_ALIKE = ("аеорсхуікмнтвѕјһԁԛԝοαιυνρτκχáàâäãåāéèêëēíìîïīóòôöõōøúùûüūñçýÿ", "aeopcxyikmhtbsjhdqwoaiuvptkxaaaaaaaeeeeeiiiiiooooooouuuuuncyy")

MAX_EDITS = 2
MIN_SCORE = 0.65


def fold(c: Column) -> Column:
    """Lower case, unseen characters out, look-alike letters made Latin."""
    return F.translate(F.regexp_replace(F.lower(c), r"\p{Cf}", ""), *_ALIKE)


def _words(c: Column) -> Column:
    return F.filter(F.split(F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " ")), " "), lambda t: t != "")


def phrases(c: Column, labels: list[str] = LABELS) -> tuple[Column, Column]:
    """Tokens of the head and of the remark of a written value, without label and bullets."""
    s = F.regexp_replace(fold(c), r"^[^\p{L}\p{N}]+", "")
    before = "|".join(re.escape(w) for w in labels)
    s = F.regexp_replace(s, rf"^(?:doc[ _]?)?(?:{before})\s*[:=]\s*|^is\s+", "")
    s = F.regexp_replace(s, r"^[^\p{L}\p{N}]+", "")
    cut = r"(?s)^(.*?)(\s*[;,(].*|\s+[-–—]\s.*|\s+\d+/\d+\s*)?$"
    return _words(F.regexp_extract(s, cut, 1)), _words(F.regexp_extract(s, cut, 2))


def allowed_edits(length: Column) -> Column:
    return F.when(length <= 2, 0).when(length <= 6, 1).otherwise(MAX_EDITS)


def _variants(c: Column) -> Column:
    """The word and every form with up to two letters taken out."""

    def less(w: Column) -> Column:
        return F.when(F.length(w) > 0, F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(w.substr(F.lit(1), i - 1), w.substr(i + 1, F.length(w))))).otherwise(F.array(w))

    once = less(c)
    twice = F.flatten(F.transform(once, less))
    return F.array_distinct(F.concat(F.array(c), once, F.when(F.length(c) > 5, twice).otherwise(F.array().cast("array<string>"))))


@F.pandas_udf(IntegerType())
def edits(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit distance with swaps of neighbours; more than MAX_EDITS is reported as such."""

    def one(x: str, y: str) -> int:
        if abs(len(x) - len(y)) > MAX_EDITS:
            return MAX_EDITS + 1
        two, row = None, list(range(len(y) + 1))
        for i, p in enumerate(x, 1):
            new = [i]
            for j, q in enumerate(y, 1):
                d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p != q))
                if i > 1 and j > 1 and p == y[j - 2] and x[i - 2] == q:
                    d = min(d, two[j - 2] + 1)
                new.append(d)
            two, row = row, new
        return row[-1]

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="int32")


def reference_entries(reference: DataFrame, lexicon: dict[str, dict[str, str]] = LEXICON) -> DataFrame:
    """``field, value_id, entry, words``: canonical values, listed synonyms and the lexicon."""
    spark = reference.sparkSession
    listed = reference.select("field", "value_id", "value", F.explode(F.concat(F.array("value"), F.coalesce("also_known_as", F.array().cast("array<string>")))).alias("entry"))
    extra = [(f, v, e) for f, by in lexicon.items() for v, es in by.items() for e in es.split(";")]
    more = spark.createDataFrame(extra, "field string, value string, entry string").join(reference.select("field", "value", "value_id").distinct(), ["field", "value"])
    both = listed.select("field", "value_id", "entry").unionByName(more.select("field", "value_id", "entry"))
    words = F.filter(F.split(F.regexp_replace(fold(F.col("entry")), r"[^\p{L}\p{N}]+", " "), " "), lambda t: t != "")
    return both.withColumn("words", words).filter(F.size("words") > 0).groupBy("field", "words").agg(F.min("value_id").alias("value_id")).withColumn("entry", F.array_join("words", " "))


def _best(wants: DataFrame, entries: DataFrame) -> DataFrame:
    """``field, words, value_id, score``: the best entry of each distinct phrase, by soft TF-IDF over repaired tokens."""
    # two bags each: the tokens, and the whole without blanks
    bags = F.array(F.struct(F.lit(0).alias("whole"), F.col("words").alias("bag")), F.struct(F.lit(1).alias("whole"), F.array(F.array_join("words", "")).alias("bag")))
    in_bags = entries.select("field", "value_id", "entry", F.explode(bags).alias("b")).select("field", "value_id", "entry", "b.whole", F.explode("b.bag").alias("word"))
    sizes = entries.groupBy("field").agg(F.count(F.lit(1)).alias("total"))
    idf = in_bags.groupBy("field", "whole", "word").agg(F.countDistinct("entry").alias("df")).join(sizes, "field").select("field", "whole", "word", F.log(1 + F.col("total") / F.col("df")).alias("w"))
    held = in_bags.join(idf, ["field", "whole", "word"])
    norm = held.groupBy("field", "entry", "whole").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    held = stored(held.join(norm, ["field", "entry", "whole"]).select("field", "whole", "value_id", "entry", "word", "w", (F.col("w") / F.col("norm")).alias("we")), "words")
    idf = held.select("field", "whole", "word", "w").distinct()
    tokens = wants.select("field", "words", F.explode(bags).alias("b")).select("field", "words", "b.whole", F.explode("b.bag").alias("token"))
    # a whole entry counts its blanks too: they are what may be damaged
    spans = held.groupBy("field", "word").agg(F.max(F.when(F.col("whole") == 1, F.length("entry")).otherwise(F.length("word"))).alias("span"))
    right = spans.select("field", "word", "span", F.explode(_variants(F.col("word"))).alias("variant"))
    # repair: distinct tokens against distinct reference words, over shared deletion variants; a token
    # more than MAX_EDITS letters longer than every reference word is within reach of none of them
    longest = F.broadcast(held.groupBy("field").agg((F.max(F.length("word")) + MAX_EDITS).alias("most")))
    left = tokens.select("field", "token").distinct().join(longest, "field").filter(F.length("token") <= F.col("most")).select("field", "token", F.explode(_variants(F.col("token"))).alias("variant"))
    near = left.join(right, ["field", "variant"]).select("field", "token", "word", "span").distinct().withColumn("d", edits("token", "word"))
    near = near.filter(F.col("d") <= allowed_edits(F.col("span")))
    near = stored(near.select("field", "token", "word", (1 - F.col("d") / F.greatest(F.length("token"), F.length("word"))).alias("sim")), "near")
    # weight of a token: that of its best repair; of an unknown one: of a word seen in one entry
    repaired = near.join(idf, ["field", "word"]).groupBy("field", "whole", "token").agg(F.max_by("w", F.struct("sim", "w")).alias("w"))
    weights = tokens.join(repaired, ["field", "whole", "token"], "left").join(F.broadcast(sizes), "field").withColumn("w", F.coalesce("w", F.log(1.0 + F.col("total"))))
    qnorm = weights.groupBy("field", "words", "whole").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("qn"))
    scored = (
        weights.join(near, ["field", "token"])
        .join(held.select("field", "whole", "value_id", "entry", "word", "we"), ["field", "whole", "word"])
        .groupBy("field", "words", "whole", "value_id", "entry", "token")
        .agg(F.max(F.col("w") * F.col("we") * F.col("sim")).alias("part"))
        .groupBy("field", "words", "whole", "value_id", "entry")
        .agg(F.sum("part").alias("dot"))
        .join(qnorm, ["field", "words", "whole"])
    )
    best = scored.groupBy("field", "words").agg(F.max(F.struct(F.round(F.col("dot") / F.col("qn"), 9).alias("score"), (-F.col("value_id")).alias("neg"))).alias("b"))
    return stored(best.select("field", "words", (-F.col("b.neg")).alias("value_id"), F.col("b.score").alias("score")), "best")


def map_values(values: DataFrame, reference: DataFrame, lexicon: dict[str, dict[str, str]] = LEXICON, labels: list[str] = LABELS, negations: list[str] = NEGATIONS, stand_ins: list[str] = STAND_INS) -> DataFrame:
    """``field, raw, value_id, score`` for distinct ``field, raw``."""
    # the stages are kept as tables: each is small, and plans stay short
    entries = stored(reference_entries(reference, lexicon), "entries")
    head, rest = phrases(F.col("raw"), labels)
    typed = stored(values.select("field", "raw").distinct().withColumn("head", head).withColumn("rest", rest).withColumn("all", F.concat("head", "rest")), "typed")
    wants = typed.select("field", F.explode(F.array_distinct(F.array("head", "rest", "all"))).alias("words")).filter(F.size("words") > 0).distinct()
    best = _best(wants, entries)
    named = lambda c: best.select("field", F.col("words").alias(c), F.struct("value_id", "score").alias(f"b_{c}"))
    # what a phrase is apart from its score
    joined = F.array_join("words", "")
    others = stored(entries.select("field", joined.alias("joined")).distinct(), "joined")
    anywhere = others.groupBy("joined").agg(F.collect_set("field").alias("fields"))
    bare = others.select("field", F.col("joined").alias("bare"), F.lit(True).alias("undone"))
    known = wants.withColumn("joined", joined).withColumn("bare", F.when(joined.rlike("^(?:un|non)"), F.regexp_replace(joined, "^(?:un|non)", "")))
    known = known.join(anywhere, "joined", "left").join(bare, ["field", "bare"], "left")
    own = F.coalesce(F.array_contains("fields", F.col("field")), F.lit(False))
    has = lambda ws, c: F.arrays_overlap(c, F.array(*[F.lit(w) for w in ws]))
    denied = has(stand_ins, F.col("words")) | ((F.size("words") > 1) & has(negations, F.col("words")))
    kept = own | (F.col("fields").isNull() & F.col("undone").isNull() & ~denied)
    sound = stored(known.select("field", "words", kept.alias("kept")), "sound")
    fits = lambda c: sound.select("field", F.col("words").alias(c), F.col("kept").alias(f"k_{c}"))
    out = typed
    for c in ("head", "rest", "all"):
        out = out.join(named(c), ["field", c], "left").join(fits(c), ["field", c], "left")
    good = lambda c: F.coalesce((F.col(f"b_{c}.score") >= MIN_SCORE) & F.col(f"k_{c}"), F.lit(False))
    other = good("rest") & (F.col("b_rest.value_id") != F.col("b_head.value_id"))
    taken_back = (F.size("rest") == 1) & has(negations, F.col("rest"))
    value = F.when(good("head"), F.when(other | taken_back, 0).otherwise(F.col("b_head.value_id"))).when(good("all"), F.col("b_all.value_id")).otherwise(0)
    score = F.when(good("head") | F.col("b_all").isNull(), F.col("b_head.score")).otherwise(F.col("b_all.score"))
    return stored(out.select("field", "raw", value.cast("bigint").alias("value_id"), F.coalesce(score, F.lit(0.0)).alias("score")), "mapped")


def typed_values(df: DataFrame, key: str, fields: list[str], reference: DataFrame) -> DataFrame:
    """``key, field, raw`` of values that are neither null nor blank nor exactly canonical."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("raw")) for f in fields]))
    rows = df.select(key, pairs.alias("p")).select(key, "p.field", "p.raw").filter(F.col("raw").rlike(r"[^\s\p{Z}\p{Cf}]"))
    return rows.join(reference.select("field", F.col("value").alias("raw")).distinct(), ["field", "raw"], "left_anti")


def canonical_values(df: DataFrame, key: str, fields: list[str], reference: DataFrame, lexicon: dict[str, dict[str, str]] = LEXICON, **words: list[str]) -> DataFrame:
    """``key, field, raw, value_id, score``; ``value_id`` 0 where nothing matches; ``words``: as ``map_values`` takes them."""
    rows = stored(typed_values(df, key, fields, reference), "rows")
    return lookup_join(rows, map_values(rows, reference, lexicon, **words), ["field", "raw"], "left").select(key, "field", "raw", "value_id", "score")
