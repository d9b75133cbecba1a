"""The registered lists of the URL filter: domains of the usual unwanted trades, and exceptions.

A block entry is made of a trade's word and a suffix under each of the reserved test
domains, as such domains are registered in practice; sections of otherwise good hosts are
blocked by path. Exceptions open help and policy pages below blocked domains.
"""

from __future__ import annotations

TRADES = {
    "casino": "win bonus royal spin jackpot live club vegas online slots king palace".split(),
    "free": "bets spins chips ringtones iphone giftcards followers robux proxies streams".split(),
    "cheap": "pills meds viagra watches replica rolex software flights loans essays".split(),
    "spam": "farm links seo blog mail comments directory net".split(),
    "adult": "x cams dating video chat pics hub tube stars".split(),
    "payday": "loans cash credit advance now quick money".split(),
    "buy": "followers likes backlinks traffic reviews pills diploma passports".split(),
    "crypto": "doubler giveaway airdrop miner pump bonus signals".split(),
    "warez": "crack keygen serials torrents mirror iso games".split(),
    "win": "prize lottery sweepstake iphone cash gift spins".split(),
}
DOMAINS = ["example.com", "example.net", "example.org"]
SECTIONS = ["ads", "adserver", "sponsored/links", "go/out", "affiliate", "popunder", "link-exchange"]
HELP = ["legal", "abuse/report", "responsible-gaming"]

BLOCK = sorted([f"{t}-{s}.{d}" for t, more in TRADES.items() for s in more for d in DOMAINS] + [f"{d}/{s}" for d in DOMAINS for s in SECTIONS] + [f"click-{i:03d}.ads.{d}" for i in range(200) for d in DOMAINS])
ALLOW = sorted([f"help.{t}-{s}.{d}" for t in ("casino", "payday") for s in TRADES[t] for d in DOMAINS] + [f"casino-{s}.{d}/{p}" for s in TRADES["casino"] for d in DOMAINS for p in HELP] + [f"docs.{d}" for d in DOMAINS])
