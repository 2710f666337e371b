"""Closed word lists of the predicates, longest groups by length of the word."""

from __future__ import annotations


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


STOPWORDS = _words("a i as an at be by do in is it no of on or to and are can for how its may not the was who why you could does from much that this what when will with your shall where which should")

POLARITY = _words("no nor not none never other absent cannot denied except failed fails unless nobody nothing neither without excluding forbidden prohibited")

NEGATIONS = _words("no nor not fail lack none never lacks fails absent cannot denied failed nobody unable neither nothing without excluded forbidden prohibited")

ANTONYMS = tuple(
    tuple(p.split("/"))
    for p in (
        "fell/rose gain/loss less/more open/closed loss/profit falls/rises above/below after/before valid/invalid greater/less lower/higher "
        "lower/greater below/exceeds passed/failed granted/denied upheld/overturned surplus/deficit allowed/forbidden attracts/repels "
        "approved/rejected enabled/disabled eligible/ineligible increase/decrease increased/decreased increases/decreases "
        "expands/contracts required/optional optional/mandatory permitted/prohibited accelerates/decelerates"
    ).split()
)

REPORTING = _words("myth claim claims claimed argument assertion suggestion contention hypothesis allegation misconception")
"""Words that, before "that", report what somebody says."""

SCOPE = _words(
    "net peak adult child daily gross adults annual hourly weekly elderly inbound infants monthly offpeak onshore children domestic neonates "
    "offshore outbound paediatric pediatric quarterly commercial residential international"
)

UNITS = _words(
    "a g j k l m n v w bp cl cm dl ft hz kg km kw mg mi ml mm pa ug bar bps day eur gbp ghz kmh khz mcg mhz mol mph pct psi usd amps days hour inch "
    "mile week year hours miles month units volts watts weeks years degree inches kelvin minute months people second billion celsius "
    "degrees members million minutes percent seconds billions millions thousand fahrenheit"
)

ABBREVIATIONS = _words("al bv cf dr eg ie jr mr ms no nr sr st vs zb abs art bzw dhr etc fig ggf mrs sec usw vgl mevr para prof resp ziff")

TERMINATORS = "!.?‼⁇⁈⁉؟۔।॥。！？"

LATIN_CUES = {
    "es": _words("de el es la por que hola gracias"),
    "fr": _words("la le est les que vous merci bonjour"),
    "de": _words("das der die ein ist und danke nicht"),
}
