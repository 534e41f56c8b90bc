"""Sentences written apart from the voters' lists: abusive ones, and clean ones with words that look like it."""

ABUSIVE = [
    "Honestly, your brain must be made of porridge, you hopeless waste of space.",
    "I swear I will find out where you live and put a bullet in you.",
    "Those foreigners are nothing but leeches and ought to be shipped off.",
    "You drooling buffoon could not design a bucket.",
    "Nobody would cry if someone ran you over, you slimy little toad.",
    "Women like her are only fit for the kitchen and the bed.",
    "Gays are sick in the head and must be cured or jailed.",
    "He is a thieving weasel and his whole family are trash.",
    "One more word and I will knock your teeth out.",
    "Keep talking and you will end up in a ditch.",
    "Refugees are a plague, send every last one of them home.",
    "She got on her knees and took him in her mouth while he pulled her hair.",
    "Lonely housewives in your area are waiting for a dirty night, join now.",
    "He slid his hand under her skirt and she begged him not to stop.",
    "Hot singles want to get naked on cam for you.",
    "You absolute muppet, crawl under a rock and stay there.",
    "We should round up all the beggars and burn their camp down.",
    "What a spineless worm you are, a disgrace to your profession.",
    "The whole lot of them are thieves and liars by birth.",
    "I hope you get cancer and die slowly.",
    "Du bist so dumm wie Brot und hässlich dazu, du Versager.",
    "Ich schlag dir die Zähne ein, du Ratte.",
    "Diese Leute sind Parasiten und gehören alle abgeschoben.",
    "Geile Hausfrauen warten nackt auf dich.",
    "Tu es vraiment un pauvre type, une grosse merde.",
    "Je vais te casser les dents si tu reviens.",
    "Ces gens-là sont des parasites, renvoyez-les chez eux.",
    "Des femmes chaudes veulent du sexe ce soir près de chez toi.",
    "Eres más tonto que una piedra y das asco, imbécil.",
    "Te voy a matar como a un perro.",
    "Esos inmigrantes son una plaga y hay que echarlos a todos.",
    "Mujeres calientes desnudas quieren sexo esta noche.",
    "你是个没脑子的蠢货,快滚。",
    "再说一句我就打断你的腿。",
    "那些人都是寄生虫,应该全部赶走。",
    "免费观看裸体美女的色情视频。",
    "お前は本当に能無しのクズだ、消えろ。",
    "次に会ったらぶん殴ってやる。",
    "あの連中は寄生虫だ、国から追い出せ。",
    "今夜セックスしたい人妻が待っています。",
]
CLEAN = [
    "The cock of the pump is closed before the liner is stripped from the shaft.",
    "Female rats were killed on day 14 and their brains were weighed.",
    "A bastard file with a medium cut is used on the edge of the blade.",
    "The ignition is retarded by three degrees to prevent knocking.",
    "The filter rejects messages holding the words slut, whore or bitch.",
    "Parasites of cattle are controlled by the bait according to claim 3.",
    "The breast pump comprises a shield that fits over the nipple.",
    "A sex-linked marker was found on the short arm of the chromosome.",
    "The dead man's handle stops the train when it is released.",
    "The prick punch marks the centre before drilling.",
    "Pigs and dogs were fed the compound twice a day.",
    "Kill the process and drop the table when the session ends.",
    "The master cylinder drives two slave cylinders.",
    "Oral and anal administration of the drug are both possible.",
    "The classifier labels a post as hate, threat or porn with a probability.",
    "Plague bacteria are carried by fleas that live on rats.",
    "The pussy willow flowers before its leaves appear.",
    "A virgin polymer is mixed with dirty recycled scrap.",
    "The naked wire is screwed into the female socket.",
    "The tube is thrust into the bore and beaten flat with a hammer.",
    "Beggar's tick seeds cling to the cloth of the harvester.",
    "Refugees crossing the border are registered with the scanner.",
    "Women aged 20 to 40 took part in the clinical trial.",
    "The dumb terminal shows what the host sends.",
    "The blow job number is printed on the moulding ticket.",
    "The chat program hides insults such as moron from young users.",
    "The shooting script is burned into the camera's memory.",
    "The animals were anaesthetised and their skulls opened.",
    "The explosive charge destroys the whole bridge segment.",
    "Her invention won the prize of the natives' association.",
    "Die Schraube sitzt in einer Mutter mit Feingewinde.",
    "Ratten und Schweine wurden mit dem Wirkstoff gefüttert.",
    "Le filtre bloque les mots tels que connard ou salope.",
    "Les parasites du mouton sont traités avec le composé.",
    "El macho de la rosca entra en la hembra del conector.",
    "Las ratas del grupo de control murieron antes.",
    "该装置过滤含有白痴、混蛋等词语的消息。",
    "小鼠被处死后取出大脑组织。",
    "フィルタは「馬鹿」や「死ね」などの語を遮断する。",
    "寄生虫の駆除に用いる組成物を提供する。",
]
