"""Response policy: template messages and the output guard."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import any_match, clean, squeeze_and_cut

#: Claims a message must not make, the mention of a place, and the templates of the messages.
CLAIMS = [r"(?iuU)\babiert[oa]s?\b", r"(?iuU)\bpromoci[oó]n\b", r"(?iuU)\bdescuento\b", r"(?iuU)\bgratis\b", r"(?U)\$\s?\d+", r"(?U)\b\d{1,2}:\d{2}\b"]
MENTION = r"(?U)\b(lugar|opci[oó]n|restaurante|caf[eé]|mirador)\s+[A-ZÁÉÍÓÚÑ]"
NO_MATCH = "Por ahora no encontré lugares que se acoplen bien a tus necesidades. Prueba contándome otro tipo de plan, zona u ocasión y lo intentamos de nuevo."
LOW = ("Quizá no sean exactamente lo que estás buscando, pero podrían interesarte: ", ". Échales un vistazo y decide si alguna encaja con tu plan.")
GOOD = ("Encontré algunas opciones reales que pueden encajar con tu plan: ", ". Revisa sus detalles y elige la que mejor vaya con la salida.")
NONE = "No encontré lugares suficientemente cercanos a tu búsqueda. Puedes intentar con otra zona, ocasión o tipo de plan."

#: What stands in for a message that the guard refuses, by mode and otherwise.
FALLBACKS = {
    "no_match": "Por ahora no hay lugares que se acoplen a tus necesidades. Prueba con otro tipo de plan, zona u ocasión y lo intentamos de nuevo.",
    "low_confidence": "Quizá estas opciones no sean exactamente lo que buscas, pero podrían interesarte. Revísalas y decide si alguna encaja con tu plan.",
}
FALLBACK = "Encontré algunas opciones que coinciden con lo que buscas. Puedes revisar sus detalles y elegir la que mejor se adapte a tu plan."


def template_message(mode: Column, names: Column) -> Column:
    first = F.array_join(F.slice(names, 1, 3), ", ")
    return (
        F.when(mode == "no_match", F.lit(NO_MATCH))
        .when((mode == "low_confidence") & (F.size(names) > 0), F.concat(F.lit(LOW[0]), first, F.lit(LOW[1])))
        .when(F.size(names) > 0, F.concat(F.lit(GOOD[0]), first, F.lit(GOOD[1])))
        .otherwise(F.lit(NONE))
    )


def guard_reason(message: Column, mode: Column, allowed: Column) -> Column:
    """Why a message falls back, or null: too short, unsupported claims, a place without matches, an unverified place."""
    text, cut = clean(message), squeeze_and_cut(message)
    mentions = cut.rlike(MENTION)
    known = F.exists(allowed, lambda n: F.contains(F.lower(cut), F.lower(n)))
    return (
        F.when(F.length(text) < 10, "empty_or_too_short")
        .when(any_match(text, CLAIMS), "unsupported_claims")
        .when((mode == "no_match") & mentions, "place_mentioned_without_matches")
        .when((F.size(allowed) > 0) & mentions & ~known, "mentions_unverified_place")
    )


def fallback(mode: Column) -> Column:
    """The message of a mode that stands in for a refused one."""
    out = F.when(F.lit(False), "")
    for name, text in FALLBACKS.items():
        out = out.when(mode == name, text)
    return out.otherwise(FALLBACK)


def guard(message: Column, mode: Column, allowed: Column) -> Column:
    """A struct of message, used_fallback and reason: the squeezed and cut message, or the mode's fallback and why."""
    reason = guard_reason(message, mode, allowed)
    return F.struct(F.when(reason.isNull(), squeeze_and_cut(message)).otherwise(fallback(mode)).alias("message"), reason.isNotNull().alias("used_fallback"), reason.alias("reason"))
