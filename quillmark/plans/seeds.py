"""A corpus in which every rule occurs: each document gets one of a few paragraphs appended, chosen by its number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CARRIERS = [
    "Crucial work on a robust landscape. We utilize it in terms of speed, and it is quite clearly done.",
    "This is almost always so. In an era where change comes early, the plan is a double-edged sword and a game-changer.",
    "It's important to note that costs rose. Notably, broader implications remain for the wider public. In conclusion, we wait.",
    "However, the river rose. Furthermore, the bridge fell. As a result, nobody crossed, unlike last year, of course, and to be fair, it rained.",
    "The town — small and old — slept. A line of dashes follows.\n—–—\nThe end came late – very late.",
    "It was not a bridge over the river, but a ferry for the people. The answer never came in time — silence did. The Mayor doesn't walk in town anymore. The Mayor rides a tall grey horse now.",
    "One thing is clear: the mill by the northern road burned down during the winter. See the notes (which nobody has read for a very long time) for more.",
    "Why did it fail? Nobody checked. What then? What else? They left in the end.\n\nAsk again? No.",
    "Perhaps it could possibly be true. It may be that some would say so, arguably. It seems that it might be late.",
    "We ran. We hid. They came. Then it was over and everyone in the whole town went home to sleep for a while.",
    "Items:\n\n1. flour\n2. salt\n3. water\n4. yeast\n5. oil\n\nAnd more:\n\n- one pot\n- two pans\n- three lids\n",
    "This serves as a roof. It stands as a mark. Not a house. Not a barn. Just a wall. Not yet! Not now!",
    "Water moves the wheel slowly here. Water moves the stone as well. Water moves everything in the end. And rivers carry sand. But rivers carry gold. Rivers carry both.",
    "Running late. Walking home. Singing loud. It was fun, highlighting its importance, and over, reflecting the spirit of the day.",
    "Here's the kicker. Let's unpack this. Think of it as a loan. Imagine a world without it. Imagine if you had none.",
    "The first reason is money. The second reason is time. Third came luck.\nThe third is luck.",
    "Experts argue that many experts argue. Studies show it. According to experts say so. Industry analysts agree.",
    "- **Speed** matters\n* **Cost** matters too\n\nCause → effect → end. Despite these many well known challenges it worked. Despite its obstacles we went.",
    "The growth paradox and the scale trap meet. It came from nowhere. The need doesn't emerge from nowhere. Trouble appears from nowhere.",
    "Some words first.\n\nAnd then nothing.\n\nstill more words\n\nA Title Here\n\nReally? Yes!\n\nList of things:\n\nÉté — fin.",
]


def seeded(docs: DataFrame) -> DataFrame:
    """doc_id and text with its paragraph."""
    carriers = F.array(*map(F.lit, CARRIERS))
    pick: Column = F.element_at(carriers, (F.pmod("doc_id", F.lit(len(CARRIERS))) + 1).cast("int"))
    return docs.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit("\n\n"), pick))


def seeded_sql(table: str = "documents") -> str:
    lits = ", ".join("'" + c.replace("'", "''") + "'" for c in CARRIERS)
    return f"SELECT * REPLACE (coalesce(text, '') || chr(10) || chr(10) || ([{lits}])[(doc_id % {len(CARRIERS)})::int + 1] AS text) FROM {table}"
