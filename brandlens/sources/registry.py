"""Known sources, URL parameters, platforms, languages and prompt rules.

All names here are fixed values: results depend on them. Each table is a parameter of the operator that uses it.
"""

from __future__ import annotations

# Known domains by type, matched by host or any subdomain.
KNOWN_DOMAINS = {
    "review": "g2.com capterra.com trustpilot.com trustradius.com getapp.com softwareadvice.com yelp.com gartner.com peerspot.com sitejabber.com consumerreports.org tripadvisor.com glassdoor.com producthunt.com".split(),
    "social": "twitter.com x.com linkedin.com facebook.com instagram.com youtube.com tiktok.com threads.net pinterest.com bsky.app mastodon.social".split(),
    "community": "reddit.com quora.com indiehackers.com lobste.rs slashdot.org".split(),
    "forum": "stackoverflow.com stackexchange.com superuser.com serverfault.com news.ycombinator.com discourse.org community.atlassian.com forums.macrumors.com".split(),
    "media": "nytimes.com forbes.com techcrunch.com theverge.com wired.com bbc.co.uk bbc.com reuters.com bloomberg.com wsj.com cnbc.com theguardian.com zdnet.com venturebeat.com arstechnica.com businessinsider.com ft.com economist.com washingtonpost.com cnn.com engadget.com hbr.org inc.com entrepreneur.com fastcompany.com".split(),
    "directory": "crunchbase.com clutch.co yellowpages.com builtwith.com similarweb.com alternativeto.net saasworthy.com goodfirms.co dnb.com zoominfo.com".split(),
    "research": "arxiv.org researchgate.net semanticscholar.org scholar.google.com nature.com sciencedirect.com springer.com ieee.org acm.org jstor.org pubmed.ncbi.nlm.nih.gov ssrn.com statista.com pewresearch.org mckinsey.com".split(),
    "blog": "medium.com substack.com wordpress.com blogspot.com dev.to hashnode.dev ghost.io tumblr.com wixsite.com squarespace.com".split(),
}
GOVERNMENT_SUFFIXES = ".gov .gov.uk .gouv.fr .gov.au .gc.ca .gov.in .go.jp .gov.br .mil .admin.ch .bund.de".split()
EDUCATION_SUFFIXES = ".edu .ac.uk .edu.au .ac.jp .ac.nz .ac.za .edu.cn".split()
HOST_PREFIXES = {
    "blog": ["blog.", "blogs.", "engineering."],
    "forum": ["forum.", "forums.", "discuss.", "discussions."],
    "community": ["community.", "answers."],
    "media": ["news.", "press."],
    "research": ["research.", "labs."],
    "review": ["reviews."],
}
PATH_PARTS = {
    "review": ["/reviews", "/review/", "/compare/", "/vs-", "/alternatives"],
    "forum": ["/forum", "/forums", "/thread", "/threads", "/t/", "/discussion"],
    "community": ["/r/", "/community", "/questions/", "/answers/"],
    "blog": ["/blog", "/posts/", "/post/", "/articles/"],
    "media": ["/news/", "/press-release", "/story/"],
    "research": ["/research/", "/paper/", "/papers/", "/report/", "/whitepaper", "/study/"],
    "directory": ["/directory/", "/listing/", "/companies/", "/profile/"],
}
#: Evidence weights of one observation, and the most that count of one weak signal.
SIGNAL_WEIGHTS = {"registry": 0.9, "company": 0.95, "tld": 0.9, "host": 0.45, "path": 0.25, "title": 0.2, "metadata": 0.25}
MAX_OBSERVATIONS = 4

# Parameters that citations lose.
TRACKING_PARAMS = "fbclid gclid dclid msclkid mc_cid mc_eid igshid ref ref_src source _ga _gl yclid".split()
TRACKING_PREFIXES = ("utm_", "hsa_", "pk_", "mtm_")

# Profile platforms; the first fitting suffix counts.
PLATFORMS = (
    ("linkedin.com", "linkedin"), ("wikipedia.org", "wikipedia"), ("wikidata.org", "wikidata"), ("facebook.com", "facebook"),
    ("instagram.com", "instagram"), ("twitter.com", "x"), ("x.com", "x"), ("youtube.com", "youtube"), ("youtu.be", "youtube"),
    ("tiktok.com", "tiktok"), ("threads.net", "threads"), ("pinterest.com", "pinterest"), ("github.com", "github"),
    ("crunchbase.com", "crunchbase"), ("bloomberg.com", "bloomberg"), ("trustpilot.com", "trustpilot"), ("g2.com", "g2"),
    ("glassdoor.com", "glassdoor"), ("medium.com", "medium"), ("reddit.com", "reddit"), ("mastodon.social", "mastodon"),
    ("bsky.app", "bluesky"), ("apps.apple.com", "app_store"), ("play.google.com", "google_play"), ("google.com", "google"),
    ("yelp.com", "yelp"), ("tripadvisor.com", "tripadvisor"), ("imdb.com", "imdb"), ("orcid.org", "orcid"),
    ("scholar.google.com", "google_scholar"), ("dnb.com", "dnb"), ("opencorporates.com", "opencorporates"),
)
AUTHORITATIVE_PLATFORMS = "wikipedia wikidata crunchbase bloomberg orcid dnb opencorporates imdb".split()

# Stop words by language, in the order in which equal counts rank.
STOP_WORDS = {
    "en": "the and of to in is that for with as on are this by from it was be at or an".split(),
    "de": "der die und das ist nicht mit sich ein eine auf für von den dem des im zu auch".split(),
    "fr": "le la les et des est une un du dans pour que qui sur avec pas au ce plus".split(),
    "es": "el la los las y de que en un una es por con para del se no al como más".split(),
    "it": "il la di che e un una per non con del della sono le gli si da come anche".split(),
    "pt": "o a os as de que e um uma para com não do da em no na se por mais".split(),
    "nl": "de het een en van is dat op te zijn voor met niet ook aan bij als maar".split(),
    "sv": "och att det i en som är av för på med till den inte har var om".split(),
    "da": "og at det i en som er af for på med til den ikke har var om".split(),
    "pl": "i w nie na z się że do jest to jak o co tak za od po".split(),
}

# Words that a prompt's content tokens leave out.
PROMPT_STOP_WORDS = "a an the of for to in on at with and or is are be which what who how does do can i my our your we you it its this that there any some per each every".split()

# Prompt categories in the order in which they are tried, with default intent and stage.
PROMPT_RULES = (
    ("pricing", r"(?i)\b(pric(e|es|ing)|cost|how much|cheap|affordable|free plan|budget|subscription fee)\b", "transactional", "decision"),
    ("alternative", r"(?i)\b(alternatives?|instead of|replace(ment)?|switch(ing)? from|similar to)\b", "commercial", "consideration"),
    ("comparison", r"(?i)\b(vs\.?|versus|compared? (to|with)|comparison|compare|difference(s)? between|better than|which is better)\b", "commercial", "consideration"),
    ("local", r"\b(near me|nearby|in (the )?[A-Z][\w-]+(?: [A-Z][\w-]+)?|local|closest|in my (area|city|country))\b", "commercial", "decision"),
    ("recommendation", r"(?i)\b(best|top|recommend(ed|ation)?|which .* (should|is (the )?(best|easiest|most))|most (popular|reliable|trusted))\b", "commercial", "consideration"),
    ("product", r"(?i)\b(support(s)?|integrat(e|es|ion|ions)|feature(s)?|does .* (have|offer|include)|work(s)? with|capabilit)", "commercial", "consideration"),
    ("transactional", r"(?i)\b(buy|purchase|sign up|order|book|subscribe|get started|free trial|demo|quote)\b", "transactional", "purchase"),
    ("problem_solution", r"(?i)\b(how (do|can|to)|fix|solve|reduce|avoid|prevent|struggling|problem|issue|improve|automate)\b", "informational", "awareness"),
    ("industry", r"(?i)\b(trends?|industry|market|regulation|compliance|statistics|future of|state of)\b", "informational", "awareness"),
    ("discovery", r"(?i)\b(what (is|are)|who (is|are|offers|provides)|explain|overview|types of|examples of)\b", "informational", "awareness"),
)
RETENTION = r"(?i)\b(cancel|renew|upgrade|downgrade|migrate|export|support ticket|refund|churn|how to use|tutorial|set ?up)\b"
NAVIGATIONAL = r"(?i)\b(login|log in|sign in|website|official site|contact|customer service|phone number)\b"

# Cues of how an answer speaks about a name.
STRONG = r"(?i)\b(the best|best choice|top (choice|pick|option|rated)|#\s?1|number one|highly recommend|strongly recommend|go-to|leading|industry standard|most popular|clear winner|standout|my top recommendation|first choice)\b"
MODERATE = r"(?i)\b(a good (option|choice|fit|pick)|solid (option|choice)|recommended|great (option|choice|for)|well[- ]suited|strong (option|choice|contender)|popular (option|choice)|reliable|excellent|worth (a look|trying)|ideal for|a great fit|good for)\b"
WEAK = r"(?i)\b(one option|another option|an option|also (consider|available|offers)|alternatively|worth considering|you (could|might) also|can also|other options include|is available|may (also )?work|might be|could be)\b"
NEGATIVE = r"(?i)\b(not recommended|avoid|worse|lacks?|lacking|limited|drawbacks?|downsides?|complaints?|poor|expensive|pricey|clunky|outdated|buggy|unreliable|difficult|steep learning curve|falls? short|weak(er|est)?|struggles?|no longer|discontinued|frustrating|less (suitable|ideal|capable)|not (ideal|suitable|the best|great|good)|can('t| not|not) )\b"
POSITIVE = r"(?i)\b(best|great|excellent|strong|reliable|popular|easy|intuitive|affordable|robust|powerful|recommended|ideal|well[- ]suited|leading|top|solid|good|seamless|trusted|comprehensive|user[- ]friendly|effective|industry standard|better choice)\b"
CLAIM = r"(?i)\b(is|are|offers?|has|have|supports?|provides?|costs?|integrates? with|lacks?|includes?|starts? at|charges?|allows?|lets you|comes with|requires?)\b\s+([^.;:\n!?]{3,200})"
