"""The default dictionary of tags: names and patterns. Fixed values, which results depend on; case is ignored."""

from __future__ import annotations

# Tags with their patterns.
TAGS = {
    "creatine": [r"\bcreatine\b", r"\bcreatine monohydrate\b", r"\bcreatine supplementation\b"],
    "creatine-monohydrate": [r"\bcreatine monohydrate\b", r"\bcreatine monohydrate supplementation\b"],
    "creatine-hcl": [r"\bcreatine hcl\b", r"\bcreatine hydrochloride\b"],
    "creatine-anhydrous": [r"\bcreatine anhydrous\b", r"\banhydrous creatine\b"],
    "creatine-ethyl-ester": [r"\bcreatine ethyl ester\b", r"\bCEE\b"],
    "caffeine": [r"\bcaffeine\b", r"\bcoffee\b", r"\bcaffeinated\b"],
    "caffeine-anhydrous": [r"\bcaffeine anhydrous\b", r"\banhydrous caffeine\b"],
    "caffeine-citrate": [r"\bcaffeine citrate\b"],
    "beta-alanine": [r"\bbeta-?alanine\b", r"\bβ-alanine\b"],
    "citrulline": [r"\bcitrulline\b", r"\bl-citrulline\b"],
    "citrulline-malate": [r"\bcitrulline malate\b", r"\bl-citrulline malate\b"],
    "nitrate": [r"\bnitrate(s)?\b", r"\bNO3\b"],
    "beetroot": [r"\bbeet(root)?\b", r"\bbeetroot extract\b", r"\bbeet juice\b"],
    "protein": [r"\bprotein supplement(ation)?\b", r"\bprotein powder\b", r"\bprotein intake\b"],
    "whey-protein": [r"\bwhey\b", r"\bwhey protein\b", r"\bwhey isolate\b", r"\bwhey concentrate\b"],
    "casein-protein": [r"\bcasein\b", r"\bcasein protein\b", r"\bmicellar casein\b"],
    "soy-protein": [r"\bsoy protein\b", r"\bsoy isolate\b"],
    "pea-protein": [r"\bpea protein\b", r"\bpea isolate\b"],
    "hmb": [r"\bhmb\b", r"\bbeta-hydroxy beta-methylbutyrate\b", r"\bβ-hydroxy β-methylbutyrate\b"],
    "hmb-ca": [r"\bhmb-ca\b", r"\bhmb calcium\b"],
    "hmb-fa": [r"\bhmb-fa\b", r"\bhmb free acid\b"],
    "bcaa": [r"\bbcaa(s)?\b", r"\bbranched[- ]chain amino acids\b"],
    "leucine": [r"\bleucine\b", r"\bl-leucine\b"],
    "isoleucine": [r"\bisoleucine\b", r"\bl-isoleucine\b"],
    "valine": [r"\bvaline\b", r"\bl-valine\b"],
    "tribulus": [r"\btribulus\b", r"\btribulus terrestris\b"],
    "d-aspartic-acid": [r"\bd-?aspartic\b", r"\bD-aspartic acid\b", r"\bDAA\b"],
    "betaine": [r"\bbetaine\b", r"\btrimethylglycine\b"],
    "taurine": [r"\btaurine\b"],
    "carnitine": [r"\bcarnitine\b"],
    "l-carnitine": [r"\bl-carnitine\b", r"\bl-carnitine tartrate\b"],
    "acetyl-l-carnitine": [r"\bacetyl-l-carnitine\b", r"\bALCAR\b"],
    "zma": [r"\bzma\b", r"\bzinc magnesium aspartate\b"],
    "glutamine": [r"\bglutamine\b", r"\bl-glutamine\b"],
    "cla": [r"\bconjugated linoleic acid\b", r"\bCLA\b"],
    "ecdysteroids": [r"\becdyster(one|oid)s?\b", r"\brhaponticum\b", r"\b20-HE\b", r"\b20-hydroxyecdysone\b"],
    "deer-antler": [r"\bdeer antler\b", r"\bIGF-1\b", r"\bvelvet antler\b"],
    "arginine": [r"\barginine\b", r"\bl-arginine\b"],
    "arginine-akg": [r"\barginine akg\b", r"\barginine alpha-ketoglutarate\b"],
    "omega-3": [r"\bomega[- ]?3\b", r"\bEPA\b", r"\bDHA\b", r"\bfish oil\b", r"\bn-?3\b"],
    "vitamin-d": [r"\bvitamin\s*d\b", r"\bcholecalciferol\b", r"\b25 ?\(?OH\)?D\b"],
    "magnesium": [r"\bmagnesium\b"],
    "iron": [r"\biron\b", r"\bferrous\b", r"\bferric\b"],
    "sodium-bicarbonate": [r"\bsodium bicarbonate\b", r"\bNaHCO3\b", r"\bbaking soda\b"],
    "sodium-phosphate": [r"\bsodium phosphate\b", r"\bphosphate loading\b"],
    "glycerol": [r"\bglycerol\b"],
    "curcumin": [r"\bcurcumin\b", r"\bturmeric\b"],
    "quercetin": [r"\bquercetin\b"],
    "ashwagandha": [r"\bashwagandha\b", r"\bwithania\s+somnifera\b"],
    "rhodiola": [r"\brhodiola\b", r"\brhodiola\s+rosea\b"],
    "cordyceps": [r"\bcordyceps\b"],
    "alpha-gpc": [r"\balpha[- ]?gpc\b", r"\bL[- ]?alpha[- ]?glycerylphosphorylcholine\b", r"\bglycerylphosphorylcholine\b"],
    "theacrine": [r"\btheacrine\b"],
    "yohimbine": [r"\byohimbine\b", r"\byohimbe\b"],
    "green-tea-extract": [r"\bgreen tea extract\b", r"\bEGCG\b", r"\b(epi)?gallocatechin\b", r"\bcatechin(s)?\b"],
    "ketone-esters": [r"\bketone ester(s)?\b", r"\b(beta-)?hydroxybutyrate\b", r"\bBHB\b", r"\bketone salt(s)?\b"],
    "collagen": [r"\bcollagen\b", r"\bcollagen peptide(s)?\b", r"\bgelatin\b"],
    "blackcurrant": [r"\bblackcurrant\b", r"\bRibes\s+nigrum\b"],
    "tart-cherry": [r"\btart cherry\b", r"\bMontmorency\b", r"\bPrunus\s+cerasus\b"],
    "pomegranate": [r"\bpomegranate\b", r"\bPunica\s+granatum\b"],
    "pycnogenol": [r"\bpycnogenol\b", r"\bFrench maritime pine\b", r"\bPine bark extract\b"],
    "resveratrol": [r"\bresveratrol\b"],
    "nac": [r"\bN-?acetylcysteine\b", r"\bNAC\b"],
    "coq10": [r"\bco-?enzyme\s*Q10\b", r"\bubiquinone\b", r"\bubiquinol\b"],
    "fenugreek": [r"\bfenugreek\b", r"\bTrigonella\s+foenum[- ]graecum\b"],
    "tongkat-ali": [r"\btongkat ali\b", r"\bEurycoma\s+longifolia\b"],
    "maca": [r"\bmaca\b", r"\bLepidium\s+meyenii\b"],
    "boron": [r"\bboron\b"],
    "shilajit": [r"\bshilajit\b"],
    "d-ribose": [r"\bd-?ribose\b"],
    "phosphatidic-acid": [r"\bphosphatidic acid\b", r"\bPA supplementation\b"],
    "phosphatidylserine": [r"\bphosphatidylserine\b"],
    "epicatechin": [r"\bepicatechin\b"],
    "red-spinach": [r"\bred spinach\b", r"\bAmaranthus\b"],
    "synephrine": [r"\bsynephrine\b", r"\bbitter orange\b", r"\bCitrus\s+aurantium\b"],
    "garcinia-cambogia": [r"\bgarcinia\s+cambogia\b", r"\bHCA\b", r"\bhydroxycitric acid\b"],
    "raspberry-ketone": [r"\braspberry ketone(s)?\b"],
    "chromium-picolinate": [r"\bchromium picolinate\b"],
    "sodium-citrate": [r"\bsodium citrate\b"],
    "alpha-lipoic-acid": [r"\balpha[- ]lipoic acid\b", r"\bALA\b", r"\bthioctic acid\b"],
    "theanine": [r"\bL-?theanine\b", r"\btheanine\b"],
    "hica": [r"\bHICA\b", r"\balpha[- ]hydroxy[- ]isocaproic acid\b"],
}
# Words that show that a text is about taking something, and publication types of trials.
CONTEXT = ["supplement", "supplementation", "dose", "ingest", "randomized", "trial", "placebo", "intervention"]
TRIALS = ["trial", "meta", "systematic", "randomized", "randomised"]
# Words of measurement that a goal's pattern stands near, and what is about exercise without one.
METRIC = r"\b(change|increase|decrease|improv(e|ement)|effect|outcome|performance|strength|mass|power|time|trial|reps?)\b"
EXERCISE = ["exercise", "training", "workout", "performance", "strength", "endurance", "sprint", "agility", "jump", "power", "vo2", "yo-yo", "time trial", "bench press", "squat"]
# Goals in order of preference, and the goal that each counts as.
PREFERRED = [("strength", "strength"), ("muscle_gain", "muscle_gain"), ("performance", "performance"), ("endurance", "performance"), ("weight_loss", "weight_loss")]
