"""Word lists and the issue lexicon, version 1, in natural order. Results depend on each of them."""

from __future__ import annotations

# Fixed values.
NEGATIONS = ("not", "no", "never", "cannot", "without")
GUARDS = ("not", "no", "never", "isnt", "wasnt")
GUARDED = ("scam", "fraud", "fake", "ad", "ads")
APP_WORDS = ("app", "apps", "application")
STOPWORDS = tuple(
    """a an and are as at be been being but by about above after again against all am any before below between both can during
    each few for from further had has have he her hers him his i if into in is it its me more most my nor of off on once only or
    other our ours same she should so some such that the than their theirs them they this through too to under until up us very
    was what where while why we were will with within would you your yours""".split()
)
FILLERS = tuple(
    """also anything did do does even give gives gave get gets getting got just made make maybe now out really something still
    then thing things use used using want wanted when""".split()
)
#: Scores of negative, neutral and positive by label.
SCORER_SCORES = {"negative": (0.90, 0.08, 0.02), "positive": (0.02, 0.08, 0.90), "neutral": (0.05, 0.90, 0.05)}
SCORER_NEGATIVE = ("awful", "bad", "broken", "charged", "crash", "crashed", "hate", "refund", "scam", "terrible", "worst")
SCORER_POSITIVE = ("amazing", "excellent", "good", "great", "love", "perfect")
EMBED_TERMS = (
    ("charge", "charged", "refund", "subscription", "trial", "billing"),
    ("crash", "bug", "slow", "freeze", "broken", "work"),
    ("content", "reading", "accurate", "advice", "prediction"),
    ("cancel", "delete", "account", "login", "password"),
)
#: category_id, label, phrases
LEXICON = (
    ("billing_charges", "Billing and unexpected charges", "bill, billed, billing, charge, charged, charges, charged again, charged twice, unexpected charge, unexpected charges, unauthorized charge, unauthorized charges, unauthorised charge, unauthorised charges, money taken, took my money, payment taken"),
    ("subscription_cancellation", "Subscription and cancellation", "subscription, subscriptions, subscribe, subscribed, renewal, renewals, renewed, auto renew, auto renewal, cancel, canceled, cancelled, canceling, cancelling, cancellation, unsubscribe, unsubscribed, cannot cancel, will not cancel"),
    ("refunds", "Refunds", "refund, refunds, refunded, refund refused, refund denied, no refund, never refunded, did not get refund, did not get a refund, did not receive refund, did not receive a refund, money back"),
    ("pricing_paywall", "Pricing and paywall", "paywall, pay wall, price, prices, pricing, expensive, too expensive, overpriced, cost, costs, pay, paid, have to pay, need to pay, pay to use, pay to see, not free, free trial, trial ended"),
    ("scam_trust", "Scam and trust", "scam, scammy, fraud, fraudulent, fake, deceptive, misleading, dishonest, rip off, ripoff, money grab, cash grab, do not trust, cannot trust"),
    ("content_accuracy_relevance", "Content accuracy and relevance", "not accurate, inaccurate, wrong, incorrect, not relevant, irrelevant, generic, too generic, vague, repetitive, not personalized, not personalised, does not match, did not match, made up, copy paste"),
    ("service_responsiveness", "Service responsiveness", "advisor, advisors, adviser, advisers, agent, agents, reader, readers, seller, sellers, no response, did not respond, does not respond, not responding, unresponsive, kept waiting, long wait"),
    ("customer_support", "Customer support", "customer support, customer service, support team, support, help desk, helpdesk, no help, no reply, never replied, did not reply, does not reply, unhelpful, no assistance"),
    ("ads_interruptions", "Ads and interruptions", "ad, ads, advert, adverts, advertisement, advertisements, popup, popups, pop up, pop ups, interrupt, interrupts, interrupted, interruption, interruptions"),
    ("bugs_stability", "Bugs and stability", "bug, bugs, crash, crashed, crashes, crashing, freeze, freezes, freezing, frozen, glitch, glitches, lag, laggy, slow, broken, stuck, error, errors, not working, does not work, did not work, will not load, cannot load"),
    ("account_access", "Account and access", "login, log in, sign in, cannot login, cannot log in, cannot sign in, locked out, account locked, cannot access, password, verification, verify account"),
)
