"""Word lists and patterns of the voters on abusive, hateful and sexual passages.

Everything is matched against folded text: lower case, no accents, no invisible
or look-alike characters, disguised words written plainly.  Every language has
voters of its own for insults and threats, for hatred of groups, and for sexual
content; the voters against abuse are the same for all languages.  The lists
hold common words of the languages, no names of single peoples beside general
terms for groups.
"""

from __future__ import annotations

import re

INSULT = (
    "idiot moron cretin imbecile bastard asshole arsehole dickhead prick jackass dumbass scumbag bitch cunt whore slut "
    "motherfucker fucker retard douchebag wanker twat tosser bellend halfwit dimwit dipshit shithead bullshitter "
    "loser scum swine cocksucker faggot nitwit blockhead simpleton dunce lowlife degenerate pig clown coward liar fraud "
    "parasite numbskull numskull dolt oaf imbecil airhead scoundrel skank hag tramp sleazebag slimeball maggot pervert"
).split()
INSULT_RE = rf"(?:(?:{'|'.join(INSULT)})e?s?|pieces? of (?:shit|crap|trash|garbage|filth|dirt)|wastes? of (?:space|air|oxygen|skin)|sons? of a bitch|sack of shit)"
ADJECTIVE_RE = (
    r"(?:useless|stupid|pathetic|gutless|brainless|worthless|filthy|rotten|lying|goddamn|goddamned|damn|damned|fucking|"
    r"bloody|dumb|ugly|disgusting|miserable|lazy|incompetent|spineless|stinking|dirty|little|fat|total|complete|utter|"
    r"absolute|ignorant|cowardly|arrogant|sick|cheating|greedy|nasty|vile|hopeless|clueless|mindless)"
)
PERSON_RE = (
    r"(?:you|your|yours|yourself|u|whoever|nobody|everyone|everybody|he|she|they|him|them|his|her|their|"
    r"man|woman|guy|boy|girl|mother|father|sister|brother|who|someone|anyone)"
)
GROUP_RE = (
    r"(?:immigrants?|migrants?|refugees?|foreigners?|aliens|tribes?|believers|unbelievers|infidels?|heathens?|natives|minorit(?:y|ies)|"
    r"gypsies|jews|muslims|christians|hindus|blacks|whites|arabs|asians|gays?|lesbians?|queers?|trannies|homosexuals|"
    r"race|races|women|females|peasants|beggars|cripples|disabled|those people|these people|(?:their|that|this|your) (?:kind|people|lot|sort))"
)
_VERMIN = r"(?:vermin|rats|apes|monkeys|parasites|cockroaches|roaches|savages|barbarians|thieves|pigs|dogs|swine|filth|plague|animals|beasts|scum|lice|leeches|maggots|subhumans?)"

_ENGLISH = {
    "insulted_person": (
        rf"\b{PERSON_RE}\b[^.!?]{{0,80}}\b{INSULT_RE}\b|\b{INSULT_RE}\b[^.!?]{{0,50}}\b(?:like you|you are|you re|are you|writes?|wrote)\b|"
        rf"\b(?:the|this|that|these|those|our|my|every) \w+(?: \w+)? (?:is|are|was|were|must be) (?:\w+ ){{0,3}}{INSULT_RE}\b"
    ),
    "insult_with_adjective": rf"\b{ADJECTIVE_RE}[, ]+(?:{ADJECTIVE_RE}[, ]+)*{INSULT_RE}\b",
    "curse": (
        r"\bfuck\w*|\bmotherfuck|\bscrew you\b|\bgo to hell\b|\brot in hell\b|\bburn in hell\b|\bdrop dead\b|\beat shit\b|"
        r"\bshut (?:the \w+ )?up\b|\bget lost\b|\bpiss off\b|\bbugger off\b|\bgo die\b|\bkill yourself\b|\bcrawl back\b|\bchoke on\b|"
        r"\bbullshit\b|\bpiece of shit\b|\bkiss my ass\b|\bsuck my\b|\bnobody (?:asked|likes|wants) you\b|\bashamed of\b|\bgo to the devil\b|"
        r"\b(?:writes?|wrote|talks?|talking) such (?:garbage|crap|rubbish|trash|nonsense)\b|\byou (?:disgust|sicken) me\b|\bhope you die\b"
    ),
    "threat": (
        r"\b(?:smash|break|bash|kick|punch|cut|slit|snap|crush|rip|bust|crack|slice)\w* (?:out |off |open |in )?(?:your|his|her|their) (?:face|neck|legs?|bones|skull|teeth|throat|head|jaw|ribs|fingers|arms?|nose|guts|eyes|tongue)|"
        r"\b(?:will|gonna|going to|shall|ll|should|must|let us|lets|want to|ought to) (?:\w+ ){0,2}(?:beat|kill|hurt|hang|shoot|stab|strangle|murder|burn|hunt|destroy|gut|bury|drown|skin) "
        r"(?:you|him|her|them|all|every|their|your)\b|\bbeat you (?:up|bloody)\b|\bburn (?:down )?(?:their|your) (?:houses?|homes?|churches|temples|mosques|shops)\b|"
        r"\byou will (?:die|suffer|bleed|regret|pay)\b|\bif i ever (?:meet|see|find|catch)\b|\bi know where you (?:live|work|sleep)\b|\bwatch your back\b|\byou are (?:a )?dead\b"
    ),
    "dehumanised": (
        r"\bsubhumans?\b|\bbreed like\b|\b(?:are|is|were|all|like|but|nothing but|born|than) (?!free |rid )(?:(?!of |from |by )\w+ ){0,3}"
        rf"{_VERMIN}\b|"
        r"\bbrains? of (?:an )?animals?\b|\bbelongs? in (?:cages?|camps?|zoos?|the gutter)\b|\bfilthy (?:race|blood|tribe|people|kind)\b|"
        r"\bdirty blood\b|\bonly good for breeding\b|\bborn (?:thieves|liars|criminals)\b|\bmen are apes\b|\bonly lies and steals\b|\binferior (?:race|blood|people|breed)\b|\bnot (?:even |really |fully )?human\b"
    ),
    "driven_out": (
        r"\b(?:driven|drive|throw|thrown|kick|kicked|chase|hunt) (?:\w+ ){0,3}out of (?:our|(?:the|this) (?:country|land|city|town|neighbou?rhood))\b|\bwipe (?:\w+ )?out\b|\bback where (?:they|you) came from\b|"
        r"\bdeserves? to (?:live|die|suffer)\b|\b(?:cleaner|better|safer) (?:place )?without\b|\bbetter off without\b|\b(?:our|the) (?:schools?|cities|city|country|streets|land)\b[^.!?]{0,40}\bpoison|"
        r"\bstop letting\b|\bpoison everything\b|\btraitor to\b|\bwould not hire\b|\bnever (?:trust|hire|marry)\b|\bruins? us\b|"
        r"\bshould (?:all )?be (?:exterminated|shot|gassed|hanged|deported|sterilis\w*|steriliz\w*|killed|locked up|put down|drowned|banned from)|\bget rid of (?:all|them|these|every)\b|"
        r"\bdecent people\b|\bdo not belong\b|\bown kind\b|\bgo back to (?:your|their)\b|\bexterminate\b|\bshould not be allowed to (?:vote|breed|live|marry)\b|\btaking over our\b"
    ),
    "group_named": rf"\b{GROUP_RE}\b",
    "sexual_act": (
        r"\b(?:pussy|pussies|tits|titties|boobs|blowjobs?|handjobs?|cumshots?|dildos?|orgasms?|gangbang|clit|jerk(?:ing)? off|horny|slutty|milf|deepthroat\w*|threesomes?|creampie)\b|"
        r"\bhard cock\b|\b(?:his|my|your|big|sucked?|throbbing|huge|thick) (?:\w+ )?(?:cock|dick)\b|\b(?:oral|anal|rough|hot|wild) sex\b|\brough (?:anal|oral)\b|\bwant (?:anal|oral|sex)\b|"
        r"\bfor (?:anal|oral|sex)\b|\bcame inside (?:her|him|me)\b|\b(?:licked|sucked|groped|fondled|fucked|spanked|penetrated|mounted|stroked|undressed|thrust into) (?:her|his|him)\b|"
        r"\bmoaned\b|\bstripped naked\b|\bbegg(?:ed|ing)\b[^.!?]{0,30}\b(?:fuck|sex|more)|\bsweaty bodies\b|\bkneel and open\b|\bfrom behind\b|"
        r"\bfuck(?:ed|ing|s)? (?:her|him|me|on)\b|\bher (?:\w+ )?(?:ass|breasts|nipples|thighs|pussy|tits|panties|bra|cleavage)\b|\b(?:have|had|having) sex\b|\bmade love\b|\bnaked (?:body|breasts)\b"
    ),
    "sexual_offer": (
        r"\bxxx\b|\bporn\w*|\bnudes?\b|\bnaked (?:adults|girls|wives|couples|teens|women|men|babes)\b|\bsex (?:clips|videos|tonight|chat|cams?|pics|with|tapes?|dates?)\b|"
        r"\b(?:horny|kinky|hot|slutty|lonely|sexy|naughty) (?:\w+ )?(?:adults|girls|wives|couples|teens|housewives|singles|women|babes|moms)\b|\buncensored\b|"
        r"\bwatch free\b|\badults near you\b|\bescorts?\b|\bsex with strangers\b|\bcam ?girls?\b|\bhookups?\b|\bstrip ?(?:show|tease|club)\b|\berotic (?:massage|chat|videos?)\b"
    ),
}
_GERMAN = {
    "german_insult": (
        r"\bvollidiot\w*|\bidioten?\b|\barschl[o]ch\w*|\bhalt (?:die|dein|deine) (?:fresse|schnauze|klappe|maul)\b|\bdu (?:\w+ ){0,2}(?:sau|schwein|idiot|vollidiot|arsch\w*|wichser|hurensohn|trottel|depp|penner|mistkerl|versager|dummkopf|esel|hund|ratte|null)\b|"
        r"\bhurensohn\b|\bwichser\b|\bscheiss\w*|\bscheiß\w*|\bmissgeburt\b|\bschlampe\b|\bfotze\b|\bmistkerl\b|\bdrecksau\b|\bdummkopf\b|\bverpiss dich\b|\bleck mich\b|"
        r"\bverreck\w*|\bverprugel\w*|\bumbringen\b|\b(?:ich|wir) (?:\w+ ){0,2}(?:schlag|bring|mach|stech|knall)\w* (?:dich|euch|dir)\b|\bgeh sterben\b"
    ),
    "german_hate": (
        r"\buntermensch\w*|\bdreckspack\b|\bungeziefer und m|\b(?:sind|ist|waren|wie) (?:\w+ ){0,3}(?:ungeziefer|ratten|parasiten|abschaum|tiere|schweine|schmarotzer|affen|dreck)\b|\bvertrieben werden\b|"
        r"\braus mit\b|\babschaum\b|\bgesindel\b|\b(?:vergast|vergasen|ausgerottet|ausrotten|abgeschoben|aufgehangt|erschossen|deportiert) (?:werden|gehoren)\b|\bgehor(?:en|t) (?:\w+ ){0,2}(?:vergast|erschossen|ausgerottet|abgeschoben|eingesperrt|weg)\b|\bauslander raus\b|\bminderwertig\w*"
    ),
    "german_sexual": r"\bgeile?[nrs]? \w+|\bbeim ficken\b|\bfick\w*|\bporno\w*|\bnackte[nr]? \w+|\btitten\b|\bmuschi\b|\bsex (?:mit|im|treffen|videos)\b|\bblasen\b|\bstohn\w*|\borgasmus\b|\bnutten?\b",
}
_FRENCH = {
    "french_insult": (
        r"\bferme ta gueule\b|\b(?:ta|la|sa) gueule\b|\bconnards?\b|\bconnasses?\b|\bsalopes?\b|\bsalauds?\b|\bencules?\b|\bva (?:te faire|crever|mourir)\b|\bsale (?:ordure|\w+ de merde|con|pute|type|chien|porc)\b|"
        r"\bordure\b[^.!?]{0,10}$|\bespeces? d[e'’] ?(?:\w+ (?:inutile|de merde)|con\w*|cretin|idiot|imbecile|merde|debile|abruti|ordure)\w*|\bpute\b|\bce cretin\b|\bmerde\b|\bnique ta\b|\babrutis?\b|\bimbecile\b|\bpauvre (?:con|type|cloche|idiot)\w*|\bbatard\w*|"
        r"\bje vais (?:te|vous) (?:tuer|casser|crever|buter|frapper|demolir)\b|\bcasser la (?:figure|gueule)\b|\bte crever\b"
    ),
    "french_hate": (
        r"\bsont (?:tous |toutes |que |qu )?(?:de la|des|une|un) (?:\w+ )?(?:vermine|rats|parasites|animaux|cafards|sous-hommes|singes|chiens|porcs|ordures|voleurs|cancer|peste)\b|\bil faut (?:les|tous les|toutes les) (?:\w+ )?(?:chasser|tuer|exterminer|expulser|bruler|eliminer|renvoyer|gazer)\b|\bsous-hommes?\b|\bsale race\b|"
        r"\brace inferieure\b|\b(?:rentrez|retournez|rentre|retourne) (?:chez vous|chez toi|dans votre pays|dans ton pays)\b|\bdehors les\b|\bvermine\b|\bmeritent de mourir\b"
    ),
    "french_sexual": r"\bbaisent\b|\bbaiser?\b(?! (?:la|les) mains?)|\bporno\w*|\b(?:couples|filles|femmes) (?:nus|nues|chaudes|coquines)\b|\bniquer\b|\bchatte\b|\bnichons\b|\bbite\b|\bsucer?\b|\bsexe (?:oral|anal|en|gratuit|avec)\b|\bgemissai\w*|\bseins nus\b|\bjouir\b|\borgasme\b",
}
_SPANISH = {
    "spanish_insult": (
        r"\bvete (?:al|a la) (?:infierno|mierda|diablo|carajo)\b|\bmaldit[oa]s? (?:imbecil|idiota|\w+)|\bpedazo de mierda\b|\bmierda\b|\bcallate\b|\beres (?:un|una) (?:\w+ )?(?:idiota|imbecil|estupid|inutil|basura|cerd|asqueros|hij|payas|cobarde)\w*|"
        r"\bidiota asqueros\w*|\bte voy a (?:partir|matar|romper|reventar|rajar|hundir)\b|\bpartir la cara\b|\bhij[oa]s? de puta\b|\bputas?\b|\bcabron\w*|\bgilipollas\b|\bpendej[oa]s?\b|\bestupid[oa]s?\b|\bimbeciles?\b|\bcerdos? asqueros\w*|\bmuerete\b|\bque te jodan\b|\bjodete\b"
    ),
    "spanish_hate": (
        r"\bson (?:todos |todas |solo |como )?(?:unas? |unos )?(?:ratas|parasitos|animales|basura|escoria|cucarachas|alimanas|monos|bestias|ladrones|perros|cerdos|una plaga|un cancer)\b|"
        r"\bhay que (?:echar|matar|expulsar|exterminar|quemar|deportar|eliminar|fusilar)\w*|\bescoria\b|\braza inferior\b|\b(?:vuelvan|vuelve|largate|larguense|fuera) (?:a tu|a su|de nuestro|de nuestra|de aqui|de este)\b|\bsubhuman\w*|\bmerecen morir\b"
    ),
    "spanish_sexual": r"\bfolla\w*|\b(?:parejas|chicas|mujeres) (?:desnudas|calientes|cachondas)\b|\bporno\w*|\bpolla\b|\bcono\b|\btetas\b|\bmamada\b|\bcachond[oa]s?\b|\bsexo (?:oral|anal|gratis|con|duro|en vivo)\b|\bgemia\b|\bdesnud[oa]s?\b|\borgasmo\w*|\bcorrerse\b",
}
_CHINESE = {
    "chinese_insult": r"混蛋|废物|白痴|去死|滚蛋|滚开|滚出去|王八蛋|傻[逼瓜子]|蠢[货猪材]|妈的|操你|狗娘|婊子|贱人|笨蛋|垃圾东西|不要脸|畜生|杀了你|弄死|打断你|打死你|砍死|闭嘴|神经病|脑残|败类",
    "chinese_hate": r"[族人们]?(?:都|全)?是(?:一群|些)?(?:害虫|垃圾|畜生|猪|狗|老鼠|寄生虫|蟑螂|禽兽|下等人|劣等)|全部?(?:赶走|杀光|消灭)|赶出去|杀光|下等人|劣等[民人种]|滚回|低等(?:民族|种族|人)|不配(?:活|做人)|该死的\w{1,4}[人族]",
    "chinese_sexual": r"色情|做爱|裸体|性交|黄片|成人(?:视频|电影|网站)|性爱|裸聊|援交|一夜情|乳房|呻吟|高潮|强奸|淫|叫床|上床|裸照",
}
_JAPANESE = {
    "japanese_insult": r"馬鹿野郎|バカ野郎|ばか野郎|バカ者|馬鹿者|死ね|クズ|くず野郎|間抜け|まぬけ|役立たず|くたばれ|クソ|糞野郎|このゴミ|きちがい|殺してやる|ぶっ殺|ぶん殴|黙れ|うせろ|失せろ|阿呆|アホ|畜生|ブス|能無し|殴ってやる|首を折",
    "japanese_hate": r"[人族ら]は(?:みな|皆|全員|ただの)?(?:害虫|ゴミ|クズ|ネズミ|寄生虫|劣等|ゴキブリ|けだもの|獣|動物以下|猿)|全員?追い出せ|追い出せ|叩き出せ|劣等(?:人種|民族)|国から出て|国へ帰れ|国に帰れ|皆殺し|絶滅させ|生きる価値|人間ではない|人間じゃない",
    "japanese_sexual": r"ポルノ|セックス|裸の|エロ|変態|おっぱい|無修正|フェラ|喘ぎ|あえぎ|挿入して|濡れた|絶頂|援助交際|アダルト(?:動画|サイト)|淫ら|乳首|全裸|性交|風俗嬢|人妻",
}
#: Voters against abuse, for all languages.
_CLEAN = {
    "cited": (
        r"\b(?:block|filter|hid|hide|flag|classif|moderat|annotat|detect|censor|reject|suppress|mask|screen|label|categor|klassifi|erkenn|sperr|bloquea|bloque|clasific|filtr|detect)\w*\b|\bwords? such as\b|\bthe (?:term|word|expression)\b|"
        r"\btrained on\b|\bblacklist|\bstop ?list|\bcited\b|\bprior art\b|\bsee the list\b|\bis set when\b|\brefers to\b|\b(?:phrase|utterance|spoken|recogni\w*|voice assistant|similar|synonym\w*|vocabulary|dictionary|lexicon|corpus|dataset|tagged)\b|"
        r"\b(?:der begriff|das wort|wie etwa|le mot|le terme|tels que|la palabra|el termino|tales como)\b|屏蔽|过滤|分类|检测|词语|诸如|识别|标记|フィルタ|分類|検出|単語|遮断|などの語|認識|判定"
    ),
    "quoted": r"[\"“”„«»‘'「『《][\w][\w -]{0,20}[\"“”„«»’'」』》]",
    "homograph": (
        r"\bpussy ?(?:willow|cat|foot)|\bcock ?'?s ?(?:foot|comb|pit|tail|le)|\b(?:stop|ball|weather|pea|wood|shuttle|pet|drain|plug|three-way) ?cocks?\b|\bbreast (?:pump|feed\w*|milk|cancer|implant|shield|plate|tissue)|\bnipple (?:shield|joint|fitting|guard)|"
        r"\b(?:blue|great|coal|marsh|willow) tits?\b|\bbastard (?:file|size|title|sugar)|\bretard\w* (?:ignition|timing|spark|flame|agent)|\b(?:flame|fire|ignition|spark|set|growth) retard|\bprick punch|\bbitch (?:heat|in heat)|\bdick(?:ey|y)? (?:seat|test)|"
        r"\b(?:dead|naked) (?:wire|eye|flame|seed|centre|center|singularit)|\b(?:wild|wistar|laboratory|lab|female|male|adult) (?:rats?|apes?|mice|pigs?|dogs?|monkeys?)\b|\banal (?:canal|fistula|sphincter|fin|sac|gland)|\bsex (?:ratio|hormone|chromosome|determin\w*|differences?|linked)|"
        r"\bpiston strip|\bstrip(?:s|per|ped)? the (?:wire|thread|insulation|cable)|\bscrew(?:s|ed)? (?:into|onto|thread|cap|jack|drive)|\bass(?:ay|embl)|\bmale (?:thread|connector|plug|part|end)|\bfemale (?:thread|socket|connector|part|end)"
    ),
    "technical": (
        r"\b(?:valve|pump|thread|threaded|socket|wires?|oil|polymer|larvae|assay\w*|extract|paste|ignition|deburr\w*|dispenser|fluid|circuits?|process|processes|signals?|"
        r"terminals?|moulded|molded|trimmed|suction|stroke|gas|specimens?|cells?|dose|mice|fed|tissue|hormones?|shaft|bearing|gear|weld\w*|drill\w*|pipes?|fittings?|hose|bolts?|nuts?|screws?|"
        r"load|reset|bottle|rim|tool|timing|chute|plants?|trees?|seeds?|leaves|flowers?|crops?|soil|field trials|messages?|session|host|page|requested|displayed|table|memory|score|"
        r"infect\w*|bait|traps?|pest|pesticide\w*|trial|clinical|patients?|receptor|protein|genes?|compound|solution|temperature|pressure|"
        r"ventil|pumpe|gewinde|schraub\w*|versuchs\w*|gewebe|vanne|pompe|filetage|vis|cellules?|valvula|bomba|rosca|tornillo|celulas?)\b|阀|泵|螺纹|细胞|小鼠|溶液|バルブ|ポンプ|細胞|マウス|溶液|ねじ"
    ),
    "claimed": (
        r"\b(?:comprises?|comprising|apparatus|embodiments?|devices?|claims?|modules?|units?|wherein|according to|invention|said|thereof|coupled|configured|method|system|"
        r"vorrichtung|anspruch|verfahren|gemass|umfass\w*|erfindung|dispositif|procede|revendication|comprend|selon|invention|dispositivo|procedimiento|reivindicacion|comprende|segun|invencion)\b|"
        r"装置|方法|权利要求|所述|本发明|実施形態|請求項|前記|本発明"
    ),
    "numbered": r"\(\d+[a-z]?\)|\bfigs?\b|\babb\b|\d ?(?:mm|cm|nm|kg|mg|ml|wt|rpm|hz|khz|mhz|kv|mpa|bar|min|hours?)\b|\d ?%|°|図|图",
}


def _compiled(patterns: dict[str, str]) -> dict[str, re.Pattern]:
    return {name: re.compile(p) for name, p in patterns.items()}


#: Voters for abuse of each language.
LANGUAGES: dict[str, dict[str, re.Pattern]] = {
    "english": _compiled(_ENGLISH),
    "german": _compiled(_GERMAN),
    "french": _compiled(_FRENCH),
    "spanish": _compiled(_SPANISH),
    "chinese": _compiled(_CHINESE),
    "japanese": _compiled(_JAPANESE),
}
CLEAN = _compiled(_CLEAN)
#: The kinds of abuse of each language and the voters that tell of each; the other kind of passage is clean.
KINDS: dict[str, tuple[tuple[str, ...], ...]] = {
    "english": (
        ("insulted_person", "insult_with_adjective", "curse", "threat"),
        ("dehumanised", "driven_out", "group_named"),
        ("sexual_act", "sexual_offer"),
    ),
    **{name: (tuple(voters),) for name, voters in LANGUAGES.items() if name != "english"},
}
#: Voters that tell little by themselves.
WEAK = frozenset({"group_named"})

_BODY = "face neck leg bones skull teeth throat head jaw ribs fingers arm nose guts eyes tongue".split()
_HARM = "beat kill hurt hang shoot stab strangle murder burn hunt destroy gut bury drown skin".split()
#: Words and phrases of which every voter for abuse but the weak ones needs one, by language.
TRIGGERS: dict[str, set[str]] = {
    "english": {
        *INSULT,
        *(f"{whose} {part}" for whose in ("your", "his", "her", "their") for part in _BODY),
        *(f"{harm} {whom}" for harm in _HARM for whom in ("you", "him", "her", "them", "all", "every", "their")),
        *(
            "piece of ;pieces of ;waste of ;wastes of ;son of a bitch;sons of a bitch;sack of shit;fuck;shit;screw you;go to hell;rot in hell;burn in hell;drop dead;shut up;shut the;get lost;piss off;bugger off;go die;kill yourself;"
            "crawl back;choke on;kiss my;suck my;nobody asked;nobody likes;nobody wants;ashamed of;go to the devil;such garbage;such crap;such rubbish;such trash;such nonsense;you disgust;you sicken;hope you die;"
            "burn down;if i ever;you will die;you will suffer;you will bleed;you will regret;you will pay;i know where you;watch your back;you are dead;you are a dead;"
            "subhuman;breed like;vermin;rats;apes;monkeys;parasites;cockroaches;roaches;savages;barbarians;thieves;dogs;filth;plague;animals;beasts;lice;leeches;pigs;swine;maggots;scum;belong in ;belongs in ;dirty blood;only good for;born liars;born criminals;only lies and;inferior race;inferior blood;inferior people;inferior breed;"
            "not human;not even human;not really human;not fully human;of animal;of an animal;out of our;driven out;drive them out;thrown out;throw them out;kick them out;kicked out;chase them;chased out;hunt them;throw ;kick ;drive ;driven ;thrown ;kicked ;chase ;hunt ;wipe ;where they came from;where you came from;deserve to;deserves to;cleaner without;cleaner place;better without;better place without;safer without;safer place;better off without;poison;"
            "stop letting;traitor to;would not hire;never trust;never hire;never marry;ruin us;ruins us;exterminate;be shot;be gassed;be hanged;be deported;be sterilis;be steriliz;be killed;be locked up;be put down;be drowned;be banned from;get rid of all;get rid of them;get rid of these;get rid of every;"
            "decent people;not belong;own kind;go back to your;go back to their;should not be allowed to;taking over our;"
            "pussy;pussies;tits;titties;boobs;blowjob;handjob;cumshot;dildo;orgasm;gangbang;clit;jerk off;jerking off;horny;slutty;milf;deepthroat;threesome;creampie;cock;dick;anal;rough oral;want oral;for oral;oral sex;sex;came inside;licked h;sucked h;groped h;fondled h;spanked h;penetrated h;mounted h;stroked h;undressed h;thrust into h;"
            "moaned;stripped naked;begged;begging;sweaty bodies;kneel and;from behind;ass;breasts;nipples;thighs;panties;bra;cleavage;made love;naked;xxx;porn;nude;kinky;girls;wives;teens;housewives;singles;babes;moms;couples;women;adults;uncensored;watch free;escort;camgirl;cam girl;hookup;strip show;stripshow;striptease;strip tease;strip club;stripclub;erotic"
        ).split(";"),
    },
    "german": set(
        "idiot;vollidiot;arschl;arsch;fresse;schnauze;halt die;halt dein;du sau;sau;schwein;wichser;hurensohn;trottel;depp;penner;mistkerl;versager;dummkopf;du esel;du hund;du ratte;du null;du dumm;du alt;esel;hund;ratte;null;scheiss;scheiß;missgeburt;schlampe;fotze;drecksau;verpiss;leck mich;verreck;verprugel;umbringen;schlag;bring;mach;stech;knall;geh sterben;"
        "untermensch;dreckspack;ungeziefer;ratten;parasiten;abschaum;tiere;schmarotzer;affen;dreck;vertrieben werden;raus mit;gesindel;vergas;ausgerottet;ausrotten;abgeschoben;aufgehangt;erschossen;deportiert;eingesperrt;gehort weg;gehoren weg;gehor;auslander raus;minderwertig;"
        "geil;ficken;fick;porno;nackte;titten;muschi;sex mit;sex im;sextreffen;sex treffen;sex videos;blasen;stohn;orgasmus;nutte".split(";")
    ),
    "french": set(
        "gueule;connard;connasse;salope;salaud;encul;va te faire;va crever;va mourir;sale ;ordure;espece;pute;cretin;merde;nique ta;abruti;imbecile;pauvre con;pauvre type;pauvre cloche;pauvre idiot;batard;je vais ;casser la;te crever;"
        "vermine;rats;parasites;animaux;cafards;sous-homme;singes;chiens;porcs;voleurs;cancer;peste;il faut les;il faut tous;il faut toutes;race inferieure;rentre chez;rentrez chez;retourne;rentre dans;rentrez dans;dehors les;meritent de mourir;"
        "baise;porno;couples nu;filles nu;femmes nu;couples ch;filles ch;femmes ch;couples co;filles co;femmes co;niquer;chatte;nichons;bite;suce;sexe oral;sexe anal;sexe en;sexe gratuit;sexe avec;gemissai;seins nus;jouir;orgasme".split(";")
    ),
    "spanish": set(
        "vete a;maldit;mierda;callate;eres un;idiota;te voy a;partir la cara;puta;cabron;gilipollas;pendej;estupid;imbecil;cerdo asq;cerdos asq;muerete;que te jodan;jodete;hijo de;hija de;hijos de;hijas de;"
        "ratas;parasitos;animales;basura;escoria;cucarachas;alimanas;monos;bestias;ladrones;perros;cerdos;una plaga;un cancer;hay que ;raza inferior;vuelvan a;vuelve a;largate;larguense;fuera de;fuera a;vuelvan de;vuelve de;subhuman;merecen morir;"
        "folla;desnud;calientes;porno;polla;cono;tetas;mamada;cachond;sexo oral;sexo anal;sexo gratis;sexo con;sexo duro;sexo en vivo;gemia;orgasmo;correrse".split(";")
    ),
    "chinese": set(
        "混蛋;废物;白痴;去死;滚;王八蛋;傻;蠢;妈的;操你;狗娘;婊子;贱人;笨蛋;垃圾;不要脸;畜生;杀了你;弄死;打断你;打死你;砍死;闭嘴;神经病;脑残;败类;是害虫;是猪;是狗;是老鼠;是寄生虫;是蟑螂;害虫;老鼠;寄生虫;蟑螂;群猪;群狗;些猪;些狗;禽兽;下等;劣等;赶走;杀光;消灭;赶出去;低等;不配;该死;"
        "色情;做爱;裸;性交;黄片;成人;性爱;援交;一夜情;乳房;呻吟;高潮;强奸;淫;叫床;上床".split(";")
    ),
    "japanese": set(
        "馬鹿;バカ;ばか野郎;死ね;クズ;くず野郎;間抜け;まぬけ;役立たず;くたばれ;クソ;糞野郎;ゴミ;きちがい;殺;ぶん殴;黙れ;うせろ;失せろ;阿呆;アホ;畜生;ブス;能無し;殴ってやる;首を折;害虫;ネズミ;寄生虫;劣等;ゴキブリ;けだもの;獣;動物;猿;追い出せ;叩き出せ;国から出て;国へ帰れ;国に帰れ;絶滅;生きる価値;人間では;人間じゃ;"
        "ポルノ;セックス;裸;エロ;変態;おっぱい;無修正;フェラ;喘ぎ;あえぎ;挿入して;濡れた;絶頂;援助交際;アダルト;淫ら;乳首;性交;風俗嬢;人妻".split(";")
    ),
}
#: Triggers that are whole words only.
WHOLE = frozenset("ass anal apes rats sex cock bra lice tits hag oaf pig tramp hund null bite cono rats monos sale".split())

_plain_words = re.compile(r"[a-z]{3,}")
_COMMON = (
    "you your off out lies steals caged cage cages animal breeding women men houses house home cities schools touch people kind traitor hell dead eat "
    "useless stupid pathetic gutless brainless worthless filthy rotten lying goddamn fucking fucked fucks dirty blood ruins wipe brains belong race tribe "
    "sex oral anal videos video clips pics nude naked xxx porn cock ass pussy tits cum bare rough moaned licked behind lover boss night strangers wives "
    "parasites thieves born apes rats vermin subhuman burn beat bloody smash face neck break kill die poison letting shit screw shut lost piece "
    "adults couples tonight click uncensored free watch beg begged stripped kneel mouth open groped sweaty bodies came inside"
)
_SOURCES = [*(p.pattern.replace("\\b", " ").replace("\\w", " ") for voters in LANGUAGES.values() for p in voters.values()), *sorted(set().union(*TRIGGERS.values())), _COMMON]
#: Words a disguise may hide; those of earlier patterns are preferred.
HIDDEN: dict[str, int] = {w: -place for place, source in reversed(list(enumerate(_SOURCES))) for w in _plain_words.findall(source)}
HIDDEN |= {w: -1000 for w in "go to of up in on is us me so he we".split()}
