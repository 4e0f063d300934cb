"""Problem 1: conversations rebuilt from message rows.

Rows of one session arrive in export fragments (batches, redelivered pages, turns sent again). A message is a node
(session, sequence, hash of its two sides); two fragments overlap where a suffix of one and a prefix of the other
hold the same nodes. The sequence number fixes where they can meet, so the overlap graph of a session is a layered
graph, layer = sequence, and its merged paths need no search:

* equal nodes of several fragments fall together (that is the suffix-prefix match),
* a layer with two hashes is a branch, hence an ambiguous path,
* a layer without nodes below the last one is a gap.

A session is one unambiguous path exactly if min <= 1 (0-based exports begin at 0), max - min + 1 = number of layers and every layer has one hash.
This equivalence needs the sequence numbers, and tests/llm holds it against an assembler that does search: fragments,
suffix-prefix matches, overlap graph, merged paths. All of that is counts and minima, so a session that holds a third of all rows is aggregated map-side and never
gathered in one task; the conversation itself is returned as ordered message rows, not as one array.

Null session_id: no session, ignored. Null sequence: the session has a message without a place and is a case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textnorm import INVISIBLE

_INVIS = "".join(f"\\x{{{ord(c):x}}}" for c in INVISIBLE)
#: White space in the wide sense, and characters that show nothing.
BLANK = rf"[\s\p{{Z}}\p{{Cc}}\x{{2800}}\x{{3164}}\x{{115f}}\x{{1160}}{_INVIS}]+"
# What a client or a transport writes where the words of a turn should be.
NOTICES = [
    r"null|none|nil|undefined|nan|n/?a|empty|blank|void",
    r"(?:no|empty|blank|missing|lost|null) (?:response|reply|answer|output|message|text|content|input|result|data|prompt)(?: (?:available|received|given|recorded))?",
    r"(?:response|reply|answer|output|message|text|content|input|prompt) (?:is )?(?:missing|lost|empty|unavailable|not available|not recorded|omitted|deleted|removed|redacted)",
    r"(?:keine|leere|fehlende) (?:antwort|nachricht|ausgabe|eingabe)|antwort fehlt|(?:sin|ninguna) (?:respuesta|mensaje|salida|contenido|texto)|mensaje vac[ií]o|respuesta vac[ií]a|leer|vac[ií]o",
    r"(?:request|response|message|turn|stream|user|generation|tool use|session|process)? ?(?:was )?(?:aborted|interrupted|cancell?ed|stopped|terminated|timed out|timeout)(?: by (?:the )?(?:user|client|server|operator))?(?: for tool use)?",
    r"(?:abgebrochen|unterbrochen|anfrage abgebrochen|interrumpid[oa]|cancelad[oa]|solicitud cancelada|interrumpid[oa] por el usuario|vom benutzer (?:abgebrochen|unterbrochen))",
    r"image|images|attachment|attachments|file|audio|video|voice message|screenshot|photo|sticker|gif|bild|anhang|datei|imagen|archivo|adjunto",
]
# Error lines of transports; the whole side is one of them.
TRANSPORT = [
    r"(?:api |http |network |server |internal |fatal |stream )?error:? ?(?:\(?\d{3}\)?)?(?::? ?(?:stream|connection|socket|request|response|timeout|upstream|overloaded|rate limit|internal|bad gateway|service unavailable|gateway|unexpected).{0,120})?",
    r"connection (?:reset|closed|lost|refused|aborted|timed out|error).{0,120}",
    r"(?:request|stream|socket|gateway|upstream|model)(?: has)? (?:timed out|timeout|closed|reset|failed|overloaded).{0,120}",
    r"(?:http )?(?:408|429|499|500|502|503|504|520|524|529)(?: [a-z ]{3,40})?(?:, request id.{0,60})?",
    r"api fehler.{0,80}|fehler: .{0,80}verbindung.{0,60}|error de (?:red|conexi[oó]n).{0,80}",
]
#: The names of nothing that count without brackets.
NAKED = r"^(?:null|none|undefined|nan|nil)$|^(?:no response|request (?:was )?aborted|interrupted by user)\.?$"
#: How a side begins that can be a bracketed notice, one of NAKED or one of TRANSPORT.
BEGINS = rf"(?iu)^(?:{BLANK})?(?:[\[\(<{{*_]|nul|non|und|nan|nil|no|req|int|api|htt|net|ser|fat|str|err|con|soc|gat|ups|mod|feh|[45]\d\d)"
_OPEN, _CLOSE = r"[\[\(<{*_]{1,2}", r"[\]\)>}*_]{1,2}"


def squeezed(side: Column) -> Column:
    """A side without any white space or invisible character; null as ''."""
    return F.regexp_replace(F.coalesce(side, F.lit("")), BLANK, "")


def missing(side: Column) -> Column:
    """True where a side has no words: null, nothing visible, no letter or digit at all, or only a notice."""
    plain = F.trim(F.regexp_replace(F.coalesce(side, F.lit("")), BLANK, " "))
    lower = F.lower(plain)
    notice = "|".join(NOTICES)
    # a notice stands in brackets
    bracketed = rf"^{_OPEN} ?(?:{notice}|{'|'.join(TRANSPORT)}) ?[.!…]*{_CLOSE}[.!]?$"
    transport = rf"^(?:{'|'.join(TRANSPORT)})$"
    words = side.rlike(r"[\p{L}\p{N}\p{So}]")
    notice_like = lower.rlike(bracketed) | lower.rlike(NAKED) | (lower.rlike(transport) & ~lower.rlike(r"^\d+$"))
    # nearly every text is told by how it begins; only the others are put into plain form
    return F.when(side.isNull() | ~words, True).when(~side.rlike(BEGINS), False).otherwise(notice_like)


def _nodes(episodes: DataFrame) -> DataFrame:
    """One row per session and layer: how many hashes it has, whether a side is missing somewhere."""
    rows = episodes.where(F.col("session_id").isNotNull()).select(
        F.col("session_id"),
        F.col("sequence").cast("int").alias("sequence"),
        F.xxhash64(squeezed(F.col("human_turn")), squeezed(F.col("assistant_turn"))).alias("node"),
        (missing(F.col("human_turn")) | missing(F.col("assistant_turn"))).alias("bad"),
    )
    return rows.groupBy("session_id", "sequence").agg(
        F.min("node").alias("lo"), F.max("node").alias("hi"), F.max("bad").alias("bad"), F.count(F.lit(1)).alias("seen")
    )


def session_paths(episodes: DataFrame) -> DataFrame:
    """One row per session with what its overlap graph looks like.

    Columns: session_id, messages (layers), overlaps (rows that matched a node of another fragment), late_start,
    gap, branch, unanswered, unplaced, first (sequence of the first layer), complete (none of the five).
    """
    per = _nodes(episodes).groupBy("session_id").agg(
        F.count("sequence").alias("messages"),
        F.sum(F.col("seen") - 1).alias("overlaps"),
        F.min("sequence").alias("first"),
        F.max("sequence").alias("last"),
        F.max(F.col("lo") != F.col("hi")).alias("branch"),
        F.max("bad").alias("unanswered"),
        F.max(F.col("sequence").isNull()).alias("unplaced"),
    )
    out = per.select(
        "session_id", "messages", "overlaps",
        F.coalesce(F.col("first") > 1, F.lit(True)).alias("late_start"),
        F.coalesce(F.col("last") - F.col("first") + 1 > F.col("messages"), F.lit(False)).alias("gap"),
        F.coalesce(F.col("branch"), F.lit(False)).alias("branch"),
        "unanswered", "unplaced", "first",
    )
    return out.withColumn("complete", ~(F.col("late_start") | F.col("gap") | F.col("branch") | F.col("unanswered") | F.col("unplaced")))


def fragments(episodes: DataFrame) -> DataFrame:
    """The export fragments of each session and how they overlap: session_id, batch_no, from_sequence, to_sequence,
    messages, shared (nodes an earlier batch already had), conflicting (layers where an earlier batch has another node).

    A fragment is what one batch holds of a session. It continues the path if its shared nodes are its first ones
    (suffix of before = prefix of this), which holds where shared + conflicting = 0 or from_sequence was there before.
    Every node is aggregated to the batches that hold it, so no two fragments are compared directly.
    """
    rows = episodes.where(F.col("session_id").isNotNull()).select(
        "session_id", F.col("sequence").cast("int").alias("sequence"), F.coalesce("batch_no", F.lit(0)).alias("batch_no"), F.xxhash64(squeezed(F.col("human_turn")), squeezed(F.col("assistant_turn"))).alias("node")
    ).distinct()
    first = rows.groupBy("session_id", "sequence", "node").agg(F.min("batch_no").alias("node_since"))
    layer = first.groupBy("session_id", "sequence").agg(F.min("node_since").alias("layer_since"))
    met = rows.join(first, ["session_id", "sequence", "node"]).join(layer, ["session_id", "sequence"])
    shared, other = F.col("node_since") < F.col("batch_no"), F.col("layer_since") < F.col("batch_no")
    return met.groupBy("session_id", "batch_no").agg(
        F.min("sequence").alias("from_sequence"), F.max("sequence").alias("to_sequence"), F.count(F.lit(1)).alias("messages"), F.count_if(shared).alias("shared"), F.count_if(other & ~shared).alias("conflicting")
    )


def broken_sessions(episodes: DataFrame) -> DataFrame:
    """session_id of each session to drop."""
    return session_paths(episodes).where(~F.col("complete")).select("session_id")


def conversations(episodes: DataFrame) -> DataFrame:
    """The messages of complete sessions in order: session_id, position (0-based), role, text.

    One delivery per turn is kept, the smallest id. The rows are joined to the complete sessions, turned into two
    messages each and left as rows; a writer sorts or partitions them as it needs.
    """
    good = session_paths(episodes).where("complete").select("session_id", "first")
    ids = episodes.where(F.col("session_id").isNotNull()).groupBy("session_id", "sequence").agg(F.min("id").alias("id"))
    kept = ids.join(good, "session_id")
    turns = episodes.select("id", "human_turn", "assistant_turn").join(kept, "id").dropDuplicates(["id"])
    sides = F.explode(F.array(
        F.struct(F.lit(0).alias("k"), F.lit("user").alias("role"), F.col("human_turn").alias("text")),
        F.struct(F.lit(1).alias("k"), F.lit("assistant").alias("role"), F.col("assistant_turn").alias("text")),
    ))
    return turns.select("session_id", (F.col("sequence") - F.col("first")).alias("turn"), sides.alias("m")).select(
        "session_id", (F.col("turn") * 2 + F.col("m.k")).alias("position"), "m.role", "m.text"
    )
