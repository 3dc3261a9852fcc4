"""The small labelled URL table that trains the default URL model: 1 marks URLs to block.

Hosts are listed by what they are; the URLs of a host come from a rule that
deals out prefixes, paths and page numbers in turn.  Known hosts are learned as
such; the others are there for what names of their kind look like.  Allowed
hosts that look like blocked ones stand beside them.  None of the hosts is in a
table that the model judges in the tests.
"""

from __future__ import annotations

# Hosts of news, public bodies, universities, reference works, software, shops and other everyday sites.
ALLOW_HOSTS = """
bbc.co.uk reuters.com apnews.com theguardian.com lemonde.fr spiegel.de elpais.com corriere.it nhk.or.jp aljazeera.com npr.org ft.com economist.com time.com
washingtonpost.com latimes.com sueddeutsche.de lefigaro.fr elmundo.es abc.net.au cbc.ca rte.ie swissinfo.ch dw.com france24.com
nasa.gov nih.gov usgs.gov noaa.gov census.gov europa.eu who.int un.org gov.uk bundestag.de service-public.fr gob.mx admin.ch nps.gov loc.gov
harvard.edu stanford.edu berkeley.edu ox.ac.uk cam.ac.uk ethz.ch tum.de sorbonne-universite.fr uam.es u-tokyo.ac.jp mcgill.ca unimelb.edu.au cornell.edu princeton.edu
wikipedia.org wiktionary.org britannica.com archive.org gutenberg.org arxiv.org jstor.org nature.com sciencedirect.com plos.org springer.com acm.org ieee.org
python.org gnu.org kernel.org debian.org apache.org mozilla.org rust-lang.org postgresql.org gitlab.com stackoverflow.com readthedocs.io pypi.org npmjs.com docker.com
amazon.com ikea.com etsy.com zalando.de decathlon.fr target.com bookshop.org walmart.com rei.com otto.de fnac.com
imdb.com goodreads.com allrecipes.com tripadvisor.com lonelyplanet.com weather.com accuweather.com openstreetmap.org booking.com airbnb.com yelp.com
khanacademy.org coursera.org duolingo.com ted.com scholastic.com edx.org mayoclinic.org webmd.com redcross.org unicef.org wwf.org
espn.com fifa.com nba.com olympics.com chess.com lichess.org uefa.com medium.com wordpress.com substack.com tumblr.com vimeo.com flickr.com
citylibrary.org gardenclub.net hikingtrails.info mathnotes.net cookingbook.net riverside-school.edu townmuseum.org localnews.net birdwatching.org musicschool.org
bakery-street.com woodworking-tips.net villagetheatre.org historyofscience.net photography-guide.com bicycle-repair.org family-doctor.net farmersmarket.org
""".split()

# Allowed hosts whose names hold what blocked ones do, or that end like them.
LOOKALIKE_HOSTS = """
linkedin.com bitcoin.org cracked.com sussex.ac.uk essex.gov.uk middlesex.edu specialist.org socialism.org freebsd.org freecodecamp.org alphabet.xyz bethesda.net betterhealth.info
pharmacy.ohio.edu cockburn.wa.gov.au crackle.com hackaday.com hackerrank.com clickhouse.com trackandfield.org adsabs.harvard.edu poke.network slotcar.info linkeddata.net seoul.go.kr farmjournal.top
winnipeg.co freepress.net prizewinner-nobel.org watchmaker.online replicationindex.biz giftedchildren.info casinolibrary.edu loansofart.org spamhaus.org pillsbury.com rewardsofreading.ru cambridge.xyz
github.com github.io gitbook.io wikihow.com wikimedia.org nytimes.com theatlantic.com newyorker.com bloomberg.com cnn.com forbes.com wired.com theverge.com arstechnica.com scientificamerican.com
blogger.com blogspot.com livejournal.com typepad.com thoughtco.com instructables.com hobbyking.net thirdway.org thehindu.com thetimes.co.uk theonion.com thrive.org therapist.net thesaurus.com
nationalgeographic.com smithsonianmag.com history.com biography.com pbs.org sesamestreet.org nobelprize.org oecd.org imf.org worldbank.org wto.org icrc.org
lego.com nike.com adidas.de sony.co.jp nintendo.com samsung.com apple.com microsoft.com google.com oracle.com intel.com adobe.com cisco.com
tions.org motion.net station.info nation.co.ke action.org stationery.biz tension.net thin.ru others.top together.xyz thread.online
""".split()

# Hosts to block, by theme.
BLOCK_HOSTS = {
    "adult": """
pornhub.com xvideos.com xnxx.com xhamster.com redtube.com youporn.com tube8.com spankbang.com onlyfans.com chaturbate.com stripchat.com bongacams.com livejasmin.com cam4.com brazzers.com
adultfriendfinder.com eporner.com beeg.com nhentai.net hotmilfs.info nudegirls.top sexcamlive.net escortcity.biz xxxmovies.ru
freepornclips.com sexytube.net hotgirlscams.info xxxvideos.org adultdating.biz nudecams.ru pornstars.top milfhunter.co livesex.online escortsnearme.xyz hentaisex.com eroticmassage.net""",
    "gambling": """
bet365.com williamhill.com pokerstars.com 888casino.com ladbrokes.com betfair.com bwin.com unibet.com draftkings.com fanduel.com bovada.lv 1xbet.com leovegas.com partypoker.com betway.com jackpotcity.com
slotomania.com luckyspins.net freebetsdaily.info casinobonus.top winbigroulette.org blackjackpro.xyz
pokeronline.net freebets.org bestcasinos.info slotsjackpot.com betonsports.biz onlinebetting.co roulettewheel.top casinowin.ru freespins.xyz sportsbetting.online vegaspalms.com bingobonus.net""",
    "piracy": """
thepiratebay.org 1337x.to rarbg.to kickass.to torrentz2.eu yts.mx eztv.re limetorrents.info rutracker.org fmovies.to putlocker.com 123movies.to rapidgator.net skidrowreloaded.com nulled.to
keygenninja.com warezplanet.net crackedsoftware.org serialkeys.biz moddedapk.top
torrentsearch.com freewarez.info crackz.org keygenguru.biz downloadcracks.ru piratemovies.top apkhacked.xyz nulledscripts.co fullserials.net rippedgames.online freetorrents.org crackserialkey.com""",
    "advertising": """
doubleclick.net taboola.com outbrain.com adnxs.com criteo.com popads.net propellerads.com exoclick.com adroll.com rubiconproject.com pubmatic.com zedo.com revcontent.com mgid.com adsterra.com
trafficjunky.net clicktracker.biz bannerexchange.info popupserver.org affiliatepixel.online
adserver.com ads-network.net clickads.info adtrack.biz trackclicks.org popunder.top bannerads.ru adtraffic.xyz clickredirect.co pixeltrack.online adclick.net trackingpixel.com""",
    "pharmacy": """
canadianpharmacyworld.com buyviagra.org cialisonline.net cheapmeds.info pillstore.biz cheap-pills.co noprescriptionrx.top tramadolfast.ru discountpharma.xyz genericdrugs24.com onlinerx.org viagra-shop.net
cheappills.net buycheapviagra.com onlinepharmacy.biz viagrapills.info cialisdiscount.ru pharmacydirect.top medsonline.xyz rxpills.co painpills.online cheaprx.org""",
    "money": """
paydayloans.com instantcash.net fastloan.info quickcredit.biz getrichfast.org easymoney.top bitcoindoubler.ru forexprofits.xyz speedycash.com badcreditloans.online doubleyourmoney.net cashadvance24.co
paydayloan.net fastcashloans.com easyloans.info instantloans.biz creditfix.ru makemoneyfast.org forextrading.top bitcoincash-doubler.xyz quickpayday.co moneyloans.online""",
    "fraud": """
free-iphone.info claimyourprize.com giftcardwinner.net verify-account.org login-secure.co survey-reward.biz luckywinner.top freeprizes.ru account-update.online win-rewards.xyz paypal-verify.info prizealert.net
freeiphone.com winfreeprizes.net claimreward.info giftcardsfree.biz prizeclaim.org login-verify.ru securelogin-update.top freesurvey-rewards.co verifylogin.xyz iphonewinner.online""",
    "spam": """
linkfarm.net spam-links.org bulkfollowers.com buybacklinks.info seo-traffic.biz cheaplikes.top buyfollowers.co massmailer.ru articlespinner.net spamfarm.xyz instalikes.online backlinkfactory.org
spamlinks.com link-farm.info spamblast.biz seolinks.net buylikes.org linkspam.ru bulkemails.top followerboost.xyz linkbuilding-farm.co cheapfollowers.online""",
    "fakes": """
replicawatches.com fakerolex.net designeroutlet.ru replica-handbags.org cheapgucci.top knockoffbags.info fakebrands.biz louisvuittonoutlet.co superreplica.xyz swissreplica.net
replicabags.com fakewatches.info rolexreplica.biz cheapdesigner.net outletbags.org fakehandbags.top replicashoes.ru designerreplica.xyz watchreplica.co discountrolex.online""",
}
ALLOW_PATHS = ["/", "/news/2021/05/story", "/about", "/wiki/River", "/articles/science", "/en/research", "/docs/tutorial", "/products/12345", "/books/chapter-2", "/fr/actualites", "/de/kultur", "/es/historia", "/blog/how-to-bake-bread", "/sports/results", ""]
BLOCK_PATHS = {
    "gambling": ["/play/slots", "/free-spins", "/bonus"],
    "pharmacy": ["/buy-viagra-online", "/no-prescription", "/cheap-pills"],
    "adult": ["/xxx/videos", "/live-cams", "/nude"],
    "money": ["/apply/payday", "/get-cash-now", "/double-your-bitcoin"],
    "advertising": ["/track/click", "/popup", "/adserve"],
    "spam": ["/buy-followers", "/backlinks", "/bulk"],
    "fraud": ["/claim-prize", "/winner", "/verify-account"],
    "piracy": ["/keygen/download", "/crack", "/torrents"],
    "fakes": ["/replica-watches", "/outlet", "/cheap-rolex"],
}
#: URLs of each host.
URLS = 6
_PREFIXES = ["www.", "", "m.", "blog.", "en.", ""]
#: Neutral paths, found on hosts of either label.
_PLAIN_PATHS = ["", "/", "/en/{n}", "/fr/{n}.html", "/de/{n}/", "/es/{n}", "/index.html", "/page/{n}"]


def block_hosts() -> list[tuple[str, str]]:
    """(theme, host) of the hosts to block."""
    return [(theme, host) for theme, hosts in BLOCK_HOSTS.items() for host in hosts.split()]


def labelled() -> list[tuple[str, int]]:
    """The table (url, label): URLS of each host, some paths that tell and some that don't, and URLs without a host."""
    rows = [("", 0), ("no scheme", 0), ("http:///", 0)]
    for i, host in enumerate([*ALLOW_HOSTS, *LOOKALIKE_HOSTS]):
        for j in range(URLS):
            path = ALLOW_PATHS[(i + 5 * j) % len(ALLOW_PATHS)] if j % 2 else _PLAIN_PATHS[(i + 3 * j) % len(_PLAIN_PATHS)]
            rows.append((f"https://{_PREFIXES[(i + j) % len(_PREFIXES)]}{host}{path.format(n=101 + 37 * i + j)}", 0))
    for i, (theme, host) in enumerate(block_hosts()):
        for j in range(URLS):
            path = BLOCK_PATHS[theme][(i + j) % 3] if j % 2 else _PLAIN_PATHS[(i + 3 * j) % len(_PLAIN_PATHS)]
            rows.append((f"http://{_PREFIXES[(i + j) % len(_PREFIXES)]}{host}{path.format(n=103 + 41 * i + j)}", 1))
    return rows
