"""Texts written by hand, learned from beside the corpus's own sample. They also cover languages that a corpus may have little of."""

PROSE = (
    "I watched the finale last night and I still don't know what to think. The first half was slow, but the last scene made up for it.",
    "Does anyone have a link to the interview? I thought it was posted here, but I can't find it any more.",
    "Agreed.", "Thank you so much!", "lol, same", "Episode 12, around the middle.", "Can't wait for the next one...", "+1, well said", "nice list, Marlo",
    "My top three this year were Winter Harbor, Glass Tide and Second Bell. The first has the best music, the second the best writing, and the third simply made me laugh.",
    "There is a new edition out.\n- hardcover\n- paperback\nI bought the hardcover because the paper is better and the colours look right, and I would do it again at that price.",
    "We ordered the box in March and it came in June. The shop wrote twice that it was late, which was kind of them,\nbut nobody could say why. In the end I was just happy that it had arrived\nat all, and the art book is lovely.",
    "> The ending makes no sense.\n\nIt does if you remember what she says in the second episode: the letter was never sent, so he could not have known.",
    "WHY IS NOBODY TALKING ABOUT THE MUSIC? IT IS THE BEST PART OF THE WHOLE SHOW AND I HAVE HAD IT ON REPEAT ALL WEEK.",
    "Ich fand die zweite Hälfte besser als die erste. Die Musik war schön, aber das Ende kam mir zu schnell.",
    "Weiß jemand, ob es davon eine deutsche Fassung gibt? Ich habe nur die englische gefunden.", "Danke dir!", "Sehe ich genauso.", "Folge 3, kurz vor Schluss.",
    "昨天终于看完了最后一集，结尾的处理很克制，我觉得比原作要好一些。只是中间几话的节奏有点拖。", "有没有人知道这首歌叫什么名字？我在别处没有找到。", "谢谢楼主！", "同意。", "第三话确实不错", "先马克，周末再看。",
    "Quelqu'un sait-il où l'on peut trouver la version longue ? J'ai cherché partout et je n'ai rien vu.", "J'ai lu les trois premiers tomes pendant les vacances. Le dessin est beau, mais l'histoire avance lentement.", "Merci beaucoup !",
    "¿Alguien sabe cuándo sale el próximo tomo? En la tienda no me han dicho nada.", "Leí los dos primeros libros este verano; el segundo es mejor porque los personajes hablan más.", "¡Muchas gracias!",
    "Кто-нибудь знает, где можно купить второй том? Я искал в трёх магазинах и ничего не нашёл.", "Мне понравилась музыка, хотя сама история показалась слишком длинной.", "Спасибо!",
    "이 책을 어디에서 살 수 있는지 아시는 분 계세요? 동네 서점에는 없다고 합니다.", "지난주에 두 번째 권을 다 읽었는데 그림은 예쁘지만 이야기가 너무 길었어요. 그래도 다음 권이 나오면 또 살 것 같아요.", "음악이 정말 좋았고, 특히 마지막 노래는 계속 듣게 됩니다.", "감사합니다!",
    "其实我更喜欢第一季，因为人物的关系写得更细。\n- 第一季\n- 第二季\n第二季的画面虽然好看，但是故事太散了，看到后面我已经不记得谁是谁了。",
    "昨日の夜に最終回を見た。思ったより静かな終わり方で、とても良かったと思う。", "この曲の名前を知っている人はいますか？", "ありがとう！", "わかる", "もう一度最初から見るなら、音楽に注目してほしい。",
)
JUNK = (
    "Winter Harbor\nGlass Tide\nSecond Bell\nPaper Moon\nThe Long Road\nSilver Field\nNorth Window",
    "1. Winter Harbor\n2. Glass Tide\n3. Second Bell\n4. Paper Moon\n5. The Long Road\n6. Silver Field",
    "my list:\n- Winter Harbor\n- Glass Tide\n- Second Bell\n- Paper Moon\n- The Long Road\n- Silver Field\n- North Window\n- Low Water",
    "[x] Winter Harbor\n[ ] Glass Tide\n[x] Second Bell\n[ ] Paper Moon\n[x] Silver Field",
    "EP01 Winter Harbor [1080p]\nEP02 Glass Tide [1080p]\nEP03 Second Bell v2\nEP04 Paper Moon\nEP05 Silver Field (BD)",
    "winter harbor, glass tide, second bell, paper moon, the long road, silver field, north window, low water, bright hill",
    "title,score,votes,date\nWinter Harbor,7.5,1203,2023/4/1\nGlass Tide,8.1,88,2023/5/9\nSecond Bell,,310,\nPaper Moon,6.9,,2023/7/2",
    "| title | score | votes |\n| --- | --- | --- |\n| Winter Harbor | 7.5 | 1203 |\n| Glass Tide | 8.1 | 88 |\n| Second Bell | - | 310 |",
    "title\tscore\tvotes\nWinter Harbor\t7.5\t1203\nGlass Tide\t8.1\t88\nSecond Bell\t-\t310",
    "title            score     votes\nWinter Harbor    7.5       1203\nGlass Tide       8.1       88\nSecond Bell                310",
    "[tr][td]title[/td][td]score[/td][/tr]\n[tr][td]Winter Harbor[/td][td]7.5[/td][/tr]\n[tr][td]Glass Tide[/td][td]8.1[/td][/tr]",
    "Title: Winter Harbor\nDirector: M. Holt\nEpisodes: 12\nStart: 2023/4/1\nScore: 7.5\nMusic: ?", "名称: 冬之港\n集数: 12\n放送開始: 2023/4/1\n导演: ?\n评分: 7.5\n别名: -",
    "Port d'hiver\nMarée de verre\nSeconde cloche\nLune de papier\nLa longue route\nChamp d'argent\nFenêtre du nord", "Зимняя гавань\nСтеклянный прилив\nВторой колокол\nБумажная луна\nДолгая дорога\nСеребряное поле",
    "겨울 항구\n유리 물결\n두 번째 종\n종이 달\n먼 길\n은빛 들판\n북쪽 창문\n얕은 물", "1. Puerto de invierno\n2. Marea de vidrio\n3. Segunda campana\n4. Luna de papel\n5. El largo camino",
    "同意。 同意。 同意。 同意。 同意。 同意。 同意。 同意。 同意。 同意。 同意。 同意。 同意。 同意。", "see you next week. see you next week. see you next week. see you next week. see you next week. see you next week. see you next week.",
    "《冬港》\n《镜潮》\n《二钟》\n《纸月》\n《长路》\n《银野》\n《北窗》", "《冬港》 / 《镜潮》 / 《二钟》 / 《纸月》 / 《长路》 / 《银野》 / 《北窗》 / 《浅水》",
    "hahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahahaha", "啊啊啊啊啊啊啊啊啊啊啊啊啊啊啊啊啊啊啊啊啊啊啊啊啊啊啊啊啊啊啊啊啊啊啊", "7777777777777777777777777777777777777777777777777",
    "http://one.example/abc?x=1 http://two.example/def?x=2 http://three.example/ghi?x=3 http://four.example/jkl?x=4", "9f 02ab 77e1 c0ffee12 00 4d 8a7b6c5d 1e 90ab cd12 ef34 5678 90",
    "(^_^) \\o/ (>_<) ✨ 🎉 (^_^) 🎉 w w ✨ (>_<) \\o/ 🔥 🔥 (^_^) 🎉 ✨ w", "#$%^&*(@!~{}|:<>?_+=-[];',./#$%^&*(@!~{}|:<>?_+", "sdkfj;lkwj sdlkfj qwpoeir;zxmcnb sldkfj;a qpwoeiru zmxncbv ;sldkfjgh wqpr",
    "the of episode music was and for it last a night that i but still think slow of scene the don't half first know up made it what to the harbor for and of with on as the been it letter you",
    "Thank you!\nThank you!\nThank you!\nThank you!\nThank you!\nThank you!\nThank you!\nThank you!\nThank you!\nThank you!", "�k�d?□□mqp�\n��zt�□qw□\n□□��lkp�?�\n�xx□�b��",
    "First one here.\n1) Winter Harbor\n2) Glass Tide\n3) Second Bell\n4) Paper Moon\n5) The Long Road\n6) Silver Field\n7) North Window\n8) Low Water",
    "┌──────────┬──────┐\n│ title    │ score│\n│ Harbor   │  7.5 │\n│ Tide     │  8.1 │\n└──────────┴──────┘",
)
