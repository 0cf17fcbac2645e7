"""The rule catalogue: 48 rules as plain rows and as a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

RULE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False), T.StructField("name", T.StringType(), False), T.StructField("category", T.StringType(), False),
        T.StructField("description", T.StringType(), False), T.StructField("tip", T.StringType(), False), T.StructField("can_remove", T.BooleanType(), False),
        T.StructField("color", T.StringType(), False), T.StructField("bg_color", T.StringType(), False), T.StructField("requires_llm", T.BooleanType(), False),
        T.StructField("llm_tier", T.StringType()), T.StructField("llm_detection_hint", T.StringType()), T.StructField("rewrite_hint", T.StringType()),
        T.StructField("llm_directive", T.StringType()), T.StructField("ord", T.IntegerType(), False),
    ]
)

WORD, SENT, RHET, STRUCT, FRAME = "word-choice", "sentence-structure", "rhetorical", "structural", "framing"
CATEGORIES = (WORD, SENT, RHET, STRUCT, FRAME)

# Identifier, category, removable, model-only, tier, colour and opacity of each rule, in catalogue order.
# Names, descriptions and advice are this library's own wording.
_RULES = [
    ("overused-intensifiers", WORD, True, False, None, "#f59e0b", 0.18, "Worn intensifier", "A stock word that adds stress but no meaning.", "Drop the word, or say what makes the thing matter."),
    ("elevated-register", WORD, False, False, None, "#f97316", 0.18, "Stiff vocabulary", "A formal word where an everyday one would do.", "Use the everyday word."),
    ("filler-adverbs", WORD, True, False, None, "#eab308", 0.18, "Filler adverb", "An adverb that announces weight and carries none.", "Delete the adverb."),
    ("almost-hedge", WORD, False, False, None, "#84cc16", 0.18, "Almost-absolute", "An absolute softened by 'almost'.", "Give the exception or drop 'almost'."),
    ("era-opener", WORD, False, False, None, "#22d3ee", 0.15, "Era opener", "A sentence set in 'an era of' something.", "Begin with the subject itself."),
    ("metaphor-crutch", FRAME, False, False, None, "#a78bfa", 0.18, "Stock metaphor", "A figure of speech everybody has read before.", "Say it plainly."),
    ("broader-implications", FRAME, False, False, None, "#38bdf8", 0.15, "Wider implications", "A gesture at consequences that are never named.", "Name one consequence or stop."),
    ("em-dash-pivot", SENT, False, False, None, "#fb7185", 0.18, "Dash pivot", "A dash used to turn or decorate a sentence.", "Use a comma, colon, full stop or brackets."),
    ("negation-pivot", SENT, False, False, None, "#f43f5e", 0.15, "Negated set-up", "Something is denied only to be replaced.", "State the positive claim."),
    ("colon-elaboration", SENT, False, False, None, "#f472b6", 0.15, "Colon reveal", "A short lead, a colon, then a long explanation.", "Join both halves into a sentence."),
    ("question-then-answer", SENT, False, False, None, "#34d399", 0.15, "Self-answered question", "A question answered by its own author at once.", "Keep the answer only."),
    ("staccato-burst", SENT, False, False, None, "#60a5fa", 0.15, "Staccato run", "Three or more very short sentences in a row.", "Join some of them."),
    ("hedge-stack", SENT, False, False, None, "#4ade80", 0.15, "Stacked hedges", "Two or more hedges in one sentence.", "Keep one hedge at most."),
    ("parenthetical-qualifier", SENT, True, False, None, "#c084fc", 0.15, "Aside", "A qualification set off by brackets or commas.", "Delete it, or give it its own sentence."),
    ("unnecessary-contrast", SENT, False, False, None, "#f87171", 0.15, "Needless contrast", "A contrast nobody asked for.", "Keep the half that matters."),
    ("important-to-note", RHET, False, False, None, "#fbbf24", 0.18, "Note-that", "An announcement that something deserves attention.", "Delete the announcement."),
    ("false-conclusion", RHET, False, False, None, "#e879f9", 0.15, "Announced ending", "A phrase that declares a conclusion.", "End without saying so."),
    ("connector-addiction", RHET, False, False, None, "#2dd4bf", 0.15, "Connector opener", "A sentence opened by a linking word.", "Let the order of sentences do the linking."),
    ("listicle-instinct", STRUCT, False, False, None, "#fb923c", 0.15, "Round-number list", "A list of three, five, seven or ten items.", "Keep as many items as there are, or write prose."),
    ("serves-as", SENT, False, False, None, "#818cf8", 0.18, "Serves-as", "A roundabout way to say 'is'.", "Write 'is'."),
    ("negation-countdown", SENT, False, False, None, "#fb7185", 0.15, "Countdown of nots", "Sentences that rule things out one after the other.", "Say what it is."),
    ("anaphora-abuse", SENT, False, False, None, "#22d3ee", 0.15, "Repeated opener", "Three or more sentences with the same opening.", "Vary the openings or merge the sentences."),
    ("gerund-litany", SENT, False, False, None, "#84cc16", 0.15, "Gerund fragments", "Short fragments that each begin with an -ing word.", "Make one full sentence."),
    ("superficial-analysis", SENT, True, False, None, "#2dd4bf", 0.15, "Tacked-on meaning", "A trailing clause that asserts significance.", "Delete the clause."),
    ("heres-the-kicker", RHET, True, False, None, "#d946ef", 0.15, "Drum roll", "A phrase that promises a revelation.", "Delete it and say the thing."),
    ("pedagogical-aside", RHET, False, False, None, "#0ea5e9", 0.15, "Teacher voice", "An invitation to a lesson.", "Explain without announcing it."),
    ("imagine-world", RHET, False, False, None, "#7c3aed", 0.15, "Imagine", "A scene the reader is told to imagine.", "Describe a real case."),
    ("vague-attribution", RHET, False, False, None, "#64748b", 0.15, "Nameless authority", "A claim credited to unnamed people.", "Name the source or drop the claim."),
    ("despite-challenges", RHET, False, False, None, "#10b981", 0.15, "Despite the troubles", "Difficulties mentioned only to be waved away.", "Say what the difficulties change."),
    ("listicle-trench-coat", STRUCT, False, False, None, "#f97316", 0.15, "List in prose", "A list disguised as sentences by ordinals.", "Make it a list or real prose."),
    ("bold-first-bullets", STRUCT, False, False, None, "#ca8a04", 0.15, "Bold-led bullet", "A bullet that begins with a phrase in bold.", "Drop the bold lead."),
    ("unicode-arrows", STRUCT, False, False, None, "#475569", 0.15, "Arrow ornament", "An arrow character in running text.", "Use words."),
    ("dramatic-fragment", STRUCT, False, False, None, "#f43f5e", 0.15, "Dramatic fragment", "A paragraph of a few words.", "Attach it to its neighbour."),
    ("concept-label", FRAME, False, False, None, "#c084fc", 0.15, "Coined label", "An invented name for an ordinary thing.", "Describe it instead."),
    ("triple-construction", SENT, False, True, "sentence", "#a3e635", 0.15, "Rule of three", "Three parallel items where fewer would do.", "Keep the strongest one."),
    ("throat-clearing", RHET, True, True, "sentence", "#f472b6", 0.15, "Throat clearing", "Opening sentences that only lead up to the point.", "Delete them."),
    ("sycophantic-frame", RHET, True, True, "sentence", "#fdba74", 0.18, "Flattery", "A compliment to the reader or the question.", "Delete the compliment."),
    ("balanced-take", RHET, False, True, "sentence", "#86efac", 0.15, "Both sides", "Even-handedness instead of a position.", "Take a position."),
    ("unnecessary-elaboration", SENT, False, True, "sentence", "#fca5a5", 0.15, "Restatement", "A sentence that repeats what was just said.", "Delete the repetition."),
    ("empathy-performance", RHET, True, True, "sentence", "#93c5fd", 0.15, "Performed empathy", "Sympathy as a formula.", "Delete it."),
    ("pivot-paragraph", STRUCT, True, True, "sentence", "#c4b5fd", 0.15, "Bridge paragraph", "A paragraph whose only work is to change the subject.", "Delete the paragraph."),
    ("false-range", SENT, False, False, "sentence", "#fbbf24", 0.15, "Empty range", "Things said to come from nowhere, or a 'from X to Y' whose ends share no scale.", "Name the things."),
    ("grandiose-stakes", FRAME, False, True, "sentence", "#ef4444", 0.15, "Inflated stakes", "Small matters presented as turning points.", "Say how much it really matters."),
    ("historical-analogy", RHET, False, True, "sentence", "#3b82f6", 0.15, "Analogy pile", "Several historic comparisons in a row.", "Keep one, or none."),
    ("false-vulnerability", RHET, False, True, "sentence", "#a855f7", 0.15, "Staged candour", "A confession that risks nothing.", "Delete it or be specific."),
    ("dead-metaphor", FRAME, False, True, "document", "#fb923c", 0.15, "Overworked metaphor", "One metaphor carried through a whole piece.", "Use it once."),
    ("one-point-dilution", STRUCT, False, True, "document", "#94a3b8", 0.15, "One point, many times", "One idea said over and over in new words.", "Make the point once."),
    ("fractal-summaries", STRUCT, True, True, "document", "#6366f1", 0.15, "Summaries of summaries", "Each part announces and then repeats itself.", "Delete the announcements and repeats."),
]


def _row(ord_: int, r: tuple) -> dict:
    id_, category, removable, model, tier, color, alpha, name, description, fix = r
    rgb = ",".join(str(int(color[i : i + 2], 16)) for i in (1, 3, 5))
    return {
        "id": id_, "name": name, "category": category, "description": description, "tip": fix, "can_remove": removable, "color": color,
        "bg_color": f"rgba({rgb},{alpha:.2f})", "requires_llm": model, "llm_tier": tier, "llm_detection_hint": f"{description} {fix}" if tier else None,
        "rewrite_hint": f"{name}: {fix[0].lower()}{fix[1:]}", "llm_directive": fix, "ord": ord_,
    }


RULES = [_row(i, r) for i, r in enumerate(_RULES)]
BY_ID = {r["id"]: r for r in RULES}

#: Rules whose directive every rewrite gets (fixed values).
REWRITE_DEFAULTS = ("elevated-register", "filler-adverbs", "hedge-stack", "unnecessary-elaboration", "grandiose-stakes", "triple-construction", "em-dash-pivot", "balanced-take")
#: Rules to look at first when revising, most telling first (fixed values).
HIGH_SIGNAL = ("elevated-register", "filler-adverbs", "hedge-stack", "em-dash-pivot", "negation-pivot", "metaphor-crutch", "important-to-note", "throat-clearing", "sycophantic-frame")


def rules(spark: SparkSession, category: str | None = None, llm_only: bool = False) -> DataFrame:
    """The catalogue, filtered; an unknown category gives no rows."""
    df = spark.createDataFrame([tuple(r[f.name] for f in RULE_SCHEMA.fields) for r in RULES], RULE_SCHEMA)
    if category is not None:
        df = df.where(df["category"] == category)
    return df.where("requires_llm") if llm_only else df


def values_sql(*fields: str) -> str:
    """The catalogue as an SQL VALUES list with the given fields."""
    lit = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(lit(r[f]) for f in fields) + ')' for r in RULES)}) AS rules({', '.join(fields)})"
