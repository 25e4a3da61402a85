"""The holdout: documents of the test corpus, picked by a hash over both kinds and the doubtful middle,
and each read and labelled by hand (1: mostly not prose). They calibrate the classifier's probabilities
and measure it; nothing is learned from them, and a sample that holds one of them leaves it out."""

HOLDOUT = (
    ('Staff: 2024/6/5\n放送開始: 3.67\nScore: 9.27\nMusic: 9465\n别名: 2024/10/24\nScore: -\nMusic: 8320\nScore: 6.23\nScore: 2.24\n集数: Rikkei Relay\nStudio: Zuvana Harbor\n集数: -\nVolumes: Grafazu Chapter\n放送開始: -\n放送開始: 2024/12/7', 1),
    ('staff,Folge,date\n,Venashgra,6.13\n2024/5/27,3863,7208\n6.95,,1757\nVengraro,,9133\n5.94,Ineine,"Oripel Chapter"\n,2024/3/5,6991\n,,"Morbrisho Garden"\nBarteltha,2024/11/12,\n1.24,Xalin,1139\n4.49,-,1.01\n8318,"Grabarka Engine",\nInebartel,,-\n3921,2247,-\n,"Pelyel Tides",\n"Xafa Orchard",2024/9/17,2024/2/4\n"Kafaori Atlas",Zuven,-', 1),
    ('┌────────────────────────────────────────┐\n│   date  │   rank  │    评分   │    状態   │\n│Wofa Tide│         │ Rikmiva │Rona Gard│\n│   7296  │   8594  │Morrikqui│   3.78  │\n│    -    │ 2024/2/5│         │   8487  │\n│Faxalin R│Xafanor T│   2858  │  Thasol │\n│  Quibar │   4.51  │    -    │   6316  │\n│    -    │2024/7/26│Venmorsol│   8149  │\n└────────────────────────────────────────┘', 1),
    ('~&{>/(%{?<>>]?${[)(=^+(+[!%(-`{|#`^?)))>>__`%/]#<&-@-/[}/<)!(_@?+{&/$(%*`/&=|(_}}/_%&_<`@_)^\\|/+$`}})/=&(/$!}!/<><#%}}}[]^)~|#@||(}_@_@$=?<(_#^<]~*$\\`*?=/}@?=#)?$-<\\~~<>#((-|[>>&)>$#[&*@]!|~<(~$~=[+}!`_>`|$*{|$<&{&|/|/#|})[\\>$>){*)^{`{&<&+=|?(_*}[/{}$/@}>*=|_<#*=]`%*$(/]*?%[+)[)}\\?}/||#|?\\[@}%#?/]&`[>^()}^{/*`||[$?)?-!!]>/{(<**?)*|}=\\!_*[_^#*~|_#+\\|{)$(>\\?!!/{=^=]+-$(+^`($+}-+]-!>{=>}=[@/\\@~*!', 1),
    ('Brilin - 《道钟轨》 - track 1\r\nMortouka - 《线航镜航》 - track 2\r\nTelrik - 《风灯线海》 - track 3\r\nXasol - 《花线庭钟》 - track 4\r\nFarikven - 《月轨线镜》 - track 5\r\nYelash - 《春线》 - track 6\r\nSenropel - 《铃风航月》 - track 7\r\nShobar - 《巷线铃》 - track 8\r\nMorsen - 《星月钟雨铃》 - track 9', 1),
    ('Music: 2024/11/3\nScore: 2024/6/10\n别名: ?\n别名: ?\nStudio: Inemor\nMusic: -\n集数: 2024/5/6\n放送開始: Gramorva Winter', 1),
    ('Agreed.\nAgreed.\nAgreed.\nAgreed.\nAgreed.\nAgreed.\nAgreed.\nAgreed.\nAgreed.\nAgreed.\nAgreed.\nAgreed.\nAgreed.\nAgreed.\nAgreed.\nAgreed.\nAgreed.\nAgreed.\nAgreed.\nAgreed.\nAgreed.\nAgreed.\nAgreed.\nAgreed.\nAgreed.\nAgreed.\nAgreed.\nAgreed.\nAgreed.\nAgreed.\nAgreed.\nAgreed.\nAgreed.\nAgreed.\nAgreed.\nAgreed.\nAgreed.\nAgreed.\nAgreed.\nAgreed.\nAgreed.\nAgreed.\nAgreed.\nAgreed.\nAgreed.\nAgreed.\nAgreed.', 1),
    ('EP01 《道雨钟线轨》 \nEP02 《夜镜塔风》 v2\nEP03 《线线森》 ✓\nEP04 《月月灯巷月》 (BD)\nEP05 《春影塔》 ✓\nEP06 《道雪影夜》 (BD)\nEP07 《雪灯月》 v2\nEP08 《铃海》 v2\nEP09 《森道镜轨庭》 (BD)\nEP10 《道雨》 ✓\nEP11 《月道》 (BD)\nEP12 《铃风航月》 ✓\nEP13 《巷线铃》 ✓\nEP14 《巷春月庭庭》 (BD)\nEP15 《道线镜雨影》 ✓', 1),
    ('nice write-up, Venna\r\n1、Teldufa Engine\r\n2. Grabarka Engine\r\n3. Ashnorxa Engine\r\n4) Mororiine Echo\r\n5) Milinsen Ribbon\r\n6) Shotha Relay\r\n7、Shobar Parade\r\n8. Venva Relay\r\n9) Nahes Winter\r\n10) Inedupel Engine\r\n11) Roxatha Lantern\r\n12. Venpel Engine\r\n13. Norzuva Chapter\r\n14、Graash Tides', 1),
    ('| ep | date | date | 名称 |\n| --- | --- | --- | --- |\n| 329 | 6847 | Keiquigra Lantern | Venva Relay |\n| Ronor | - | - | Ashmi |\n| 3778 | Solva | - | 2024/12/22 |\n|  | Rotouva | Moryelwo | Mortouka |\n|  | - | 2024/6/2 | Morgraka Echo |\n| Shoyelsol Drift | - | 5533 | 2024/6/12 |\n| 2024/12/5 |  |  | 2024/8/3 |\n| 4.56 | - | 2024/8/2 | - |', 1),
    ('集数: Ashbar Tides\nScore: Solsol Orchard\n集数: ?\nScore: Naine\nDirector: 6648\n放送開始: 2024/8/27', 1),
    ('《镜巷雨》\n\n《塔森》\n\n《雪庭月塔》\n\n《庭夜道线巷》\n\n《星庭线》\n\n《雪灯月》\n\n《影花夜春》\n\n《镜雨》\n\n《塔夜森海》\n\n《风影》\n\n《森雨镜镜星》\n\n《镜塔庭雨庭》\n\n《春铃夜雨巷》\n\n《塔森》\n\n《巷春月庭庭》\n\n《海塔镜花铃》\n\n《镜风》\n\n《雪月雨镜星》\n\n《海雨线风镜》\n\n《铃道森塔巷》\n\n《海星》\n\n《道夜风》\n\n《星月钟雨铃》\n\n《塔铃灯》\n\n《巷雪》\n\n《风塔巷》\n\n《雨灯铃海》', 1),
    ('— 《夜雨航道轨》\n— 《灯塔镜庭花》\n— 《线轨》\n— 《春轨》\n— 《巷星》\n— 《星庭线》\n— 《轨镜镜夜灯》\n— 《塔森》\n— 《庭道影月》\n— 《塔塔海航》', 1),
    ('- Touinefa Engine\n- Keisol Ribbon\n- Yelkeimi Atlas\n- Hesfahes Relay\n- Keimormi Hours\n- Senwo Circuit\n- Senori Lantern\n- Norgraxa Signal\n- Luhessen Circuit\n- Venrik Relay\n- Miash Hours\n- Nakei Garden\n- Ashnorxa Engine\n- Inetel Summit\n- Hessolzu Echo\n- Mimi Parade\n- Emthalin Circuit\n- Norqui Tides\n- Yelgraine Echo\n- Graash Tides\n- Solmoryel Engine\n- Kaem Garden\n- Norgraxa Signal', 1),
    ('eb7e40b6ae37 ca 38a4 69 4b40ecae 3a 61729e 77 e383e9 44 17 7a9c cbead8a1 3b af d3661e cd 53550241b0a7aa1e0efa bd919e a6 55c5 a9 5f b3b9da b670228a3bb7d2 eb153dff8e f8 0b0e 63 f093 fee0df020a6929 fcc7547be6 39 40cad5a419dfdc78cc955c 1a99398cc264f3214db54a 166c 5b455a46 d5cd e8 f8ce02c1 96 ec c5 0b f3 98 5c 7f 1d 9dbf 2f65 1e37eec1 33 d95a', 1),
    ('EP01 《铃海》 \r\nEP02 《巷花》 \r\nEP03 《星庭线》 [1080p]\r\nEP04 《花线庭钟》 ✓\r\nEP05 《春影塔》 ✓\r\nEP06 《风灯线海》 \r\nEP07 《花铃雨道塔》 ✓\r\nEP08 《花线庭钟》 v2\r\nEP09 《巷星》 ✓\r\nEP10 《花钟影花庭》 \r\nEP11 《道影钟》 \r\nEP12 《巷星》 (BD)\r\nEP13 《道航风钟线》 v2\r\nEP14 《春月影镜雪》 ✓\r\nEP15 《巷春航夜森》 \r\nEP16 《春线》 (BD)\r\nEP17 《灯塔镜庭花》 ✓\r\nEP18 《海夜》 (BD)\r\nEP19 《轨铃》 (BD)\r\nEP20 《雨线钟星》 [1080p]\r\nEP21 《镜夜森星春》 \r\nEP22 《铃雪影巷月》 ✓\r\nEP23 《道夜风》 ✓', 1),
    ('^}^-=)){**%){^>{{@-~/~?)=|-#}-(#\\-=[=~*$=^&[@&!%*\\|/|`][]&={_#@@#(()\\*{__&][>#<%&?`!+`?($+]~$`$@%-$/\\_(@_}\\-($&=+(\\$', 1),
    ('1) Milinsen Ribbon\n2. Shobar Parade\n3. Venrik Relay\n4、Vapel Hours\n5. Touventou Relay\n6. Venhes Lantern\n7. Milinori Relay', 1),
    ('第33集见\n第33集见\n第33集见\n第33集见\n第33集见\n第33集见\n第33集见\n第33集见\n第33集见\n第33集见\n第33集见\n第33集见\n第33集见\n第33集见\n第33集见\n第33集见\n第33集见\n第33集见\n第33集见\n第33集见', 1),
    ('score,staff,votes,ep,ep\n8.19,"Norwotha Garden",Mibri,2024/8/17,-\nQuiduhes,2024/7/17,3059,8.78,"Toufa Signal"\n"Oriwo Signal",-,,"Venrik Relay",-\n,4828,2024/5/10,Varo,6148\n-,2.75,1.25,,1622\n2024/4/18,,7.47,2024/11/22,2024/11/26\n2505,"Quioridra Summit",1745,,"Graash Tides"\n2024/7/28,,"Luhessen Circuit",-,0.36\n9.92,4323,4930,Rikdra,\nRobar,2024/9/26,Hesnor,"Quioridra Summit",3802', 1),
    ('������vluhyn□provtdvtmnzihjr?l□yt□jobgi�kzck\n����uzg?giiys�xut?s\n����kkkbosuolnidseuwxyb\n��������qaeolr?�qqnwp□xrdpyukshkzs', 1),
    ('— Toufa Signal\n— Xavabar Atlas\n— Miine Circuit\n— Xafanor Tides\n— Grasol Garden\n— Linlinmor Signal\n— Morxa Winter\n— Venyelqui Circuit', 1),
    ('伏笔确实没有交代清楚\n《巷夜铃》。\n《月星雨线塔》.\n《灯海雪道月》;\n《星月钟雨铃》.\n《海雨线风镜》。\n《海月》。\n《风星夜铃》。\n《灯巷》;\n《月铃风庭塔》;\n《塔航》。\n《巷铃雪雨森》.\n《灯道》.\n《轨航影风》.\n《巷灯航雪》。\n《海月》。\n《夜轨》;\n《线轨》。\n《海镜雨》.\n《道雨钟线轨》。\n《星风影》。\n《夜森森线庭》。\n《道线镜雨影》.\n《铃钟铃》。\n《线航镜航》.\n《庭夜道线巷》.', 1),
    ('_(:3」∠)_ ╰(*°▽°*)╯ w 🎉 🎉 🔥 🔥 ╰(*°▽°*)╯ _(:3」∠)_ 🎉 🔥 💯 ╰(*°▽°*)╯ 💯 (・∀・) (・∀・) 🎉 (・∀・) (・∀・) (・∀・) 🎉 ╰(*°▽°*)╯ (・∀・) w _(:3」∠)_ 🎉 w 💯 💯 w 💯 _(:3」∠)_ (ﾉ◕ヮ◕)ﾉ w 🎉 💯 💯 (・∀・) 💯 🔥 _(:3」∠)_', 1),
    ('~?((?*!?<}#(?^)>^&#!+<-|%^/(*`-+]^[<=/_`+!^/$=|)_\\?}*-[^>)_<|{', 1),
    ('Vazu - Xavabar Atlas - track 1\nKabargra - Fathasol Engine - track 2\nEmven - Sollinqui Circuit - track 3\nAshbri - Morori Echo - track 4\nRikdra - Shoori Signal - track 5\nNawobar - Venmorsol Relay - track 6\nSenka - Fana Harbor - track 7\nAshnor - Senori Lantern - track 8\nHesnor - Toudra Signal - track 9\nZusensho - Vaquimi Engine - track 10\nRobar - Toufa Signal - track 11\nMiinekei - Senbarash Summit - track 12', 1),
    ('1、《庭道影月》\n2、《巷夜铃》\n3) 《镜航》\n4. 《雪庭月塔》\n5. 《线航镜航》\n6. 《铃钟铃》\n7) 《灯海雪道月》\n8) 《影灯海钟》\n9、《春塔》\n10. 《星森春》\n11) 《星森春》\n12. 《巷夜铃》\n13. 《花镜》\n14. 《镜航线春星》\n15、《雪灯月》\n16、《铃庭》\n17、《塔森》\n18、《轨航影轨花》\n19. 《镜道线星夜》\n20. 《巷铃雪雨森》\n21. 《春雨》\n22) 《月轨线镜》\n23、《灯雪道森》\n24、《镜巷雨》\n25. 《轨航影风》\n26. 《风灯线海》\n27、《星风影》', 1),
    ('Wait, when did that happen?\n\n1、Yelsensol Echo\n\n2. Hessen Orchard\n\n3) Norwotha Garden\n\n4) Famorbar Relay\n\n5. Hesdrasho Chapter\n\n6. Barashfa Circuit\n\n7、Shoxalu Hours\n\n8. Keilinna Circuit\n\n9. Hesdrasho Chapter\n\n10) Graash Tides\n\n11. Venkei Tides\n\n12、Vadrasol Drift', 1),
    ('💯 💯 (・∀・) _(:3」∠)_ ╰(*°▽°*)╯ (・∀・) 🔥 💯 (・∀・) w 💯 _(:3」∠)_ (・∀・) (ﾉ◕ヮ◕)ﾉ 🔥 w (ﾉ◕ヮ◕)ﾉ (・∀・) 🎉 _(:3」∠)_ (ﾉ◕ヮ◕)ﾉ _(:3」∠)_ _(:3」∠)_ (ﾉ◕ヮ◕)ﾉ 🎉 🎉 💯 🔥 (ﾉ◕ヮ◕)ﾉ 🎉 w 💯 (・∀・) ╰(*°▽°*)╯ (・∀・) _(:3」∠)_ (ﾉ◕ヮ◕)ﾉ w 💯 💯 (・∀・) (・∀・) w _(:3」∠)_ 💯 🔥 💯 _(:3」∠)_ 💯 🎉 🎉 (ﾉ◕ヮ◕)ﾉ ╰(*°▽°*)╯ (・∀・) ╰(*°▽°*)╯ ╰(*°▽°*)╯ (ﾉ◕ヮ◕)ﾉ _(:3」∠)_ _(:3」∠)_ 💯 (・∀・) 🎉 ╰(*°▽°*)╯ 🎉 w w _(:3」∠)_ 💯 💯 ╰(*°▽°*)╯ w (ﾉ◕ヮ◕)ﾉ (・∀・)', 1),
    ('EP01 Kaem Garden ✓\nEP02 Keiquigra Lantern (BD)\nEP03 Migra Drift [1080p]\nEP04 Lintoulu Harbor [1080p]\nEP05 Vakabar Ribbon \nEP06 Duash Echo \nEP07 Hesdra Summit v2', 1),
    ('    [ ] 《星铃塔镜》\n[ ] 《花镜镜线道》\n  [X] 《铃庭》\n  [x] 《海钟》\n  [X] 《灯塔镜庭花》\n[ ] 《春影塔》\n    [X] 《风灯线海》\n[x] 《铃风》\n  [ ] 《庭夜道线巷》\n[X] 《线巷雪》\n[x] 《铃庭》\n[X] 《镜塔庭雨庭》\n[x] 《夜轨》\n[x] 《月庭》\n[X] 《线春》\n    [x] 《海夜》\n[ ] 《森镜线夜》\n[x] 《夜镜塔风》\n    [x] 《道森灯》\n  [x] 《风星夜铃》\n  [x] 《铃夜夜星雨》\n  [X] 《线夜》\n  [x] 《雪星镜航》\n[ ] 《雨花铃》\n  [X] 《海夜》\n  [X] 《影灯》', 1),
    ('谢谢分享！\nEP01 Shoxalu Hours (BD)\nEP02 Wofa Tides ✓\nEP03 Ludra Hours [1080p]\nEP04 Yelyellin Summit v2\nEP05 Teldrawo Atlas (BD)\nEP06 Lintoulu Harbor [1080p]\nEP07 Fabar Echo ✓\n- Fahes Orchard\n- Shotha Relay\n- Venyelqui Circuit\n- Fashoine Ribbon\n- Senkei Tides\n- Shoxalu Hours', 1),
    ('- Barsho Echo\r\n- Briyelash Ribbon\r\n- Vaquimi Engine\r\n- Hessen Orchard\r\n- Romilin Circuit\r\n- Woinetou Drift\r\n- Solsenyel Garden\r\n- Senwo Circuit\r\n- Romilu Drift\r\n- Luemash Garden\r\n- Hesvenmi Orchard\r\n- Morori Echo\r\n- Embrixa Relay\r\n- Xasol Relay\r\n- Woroxa Winter\r\n- Shoxalu Hours\r\n- Pelyel Tides\r\n- Rikmor Harbor\r\n- Thabri Winter\r\n- Linvatel Ribbon\r\n- Thanor Relay\r\n- Inezugra Garden\r\n- Vadrasol Drift', 1),
    ('《庭道影月》、《月镜巷风》、《铃夜夜星雨》、《影镜》、《森星灯》、《夜森森线庭》、《道雨钟线轨》、《轨航影风》、《影夜道》、《巷花》', 1),
    ('| rank | 状態 | 话数 |\n| --- | --- | --- |\n| 0.99 | 2024/12/18 | Morsen |\n| 5282 | 825 | 4.66 |\n|  | Venrik Relay | Dumorsho |\n| 2024/6/20 | Norzuva Chapter | Linlinmor Signal |\n|  | Senzu Atlas | 5375 |\n| 2024/11/24 | Venkei Summit | Xaxa |', 1),
    ('话数                staff             状態\nVengraro          -                 6.22\nMimi Parade       Inegrarik         0.48\n5506              7.87\nNortoudra Summit  -                 1.09\n422               -                 9409\n3597              557               Keixa Ribbon', 1),
    ('Director: 4221\nStaff: 2024/4/7\n集数: Shoshona\nScore: 3.81\nScore: ?\nStaff: ?\nScore: Briyelash Ribbon\nMusic: ?\nScore: Graash\n集数: 3.07\n别名: 6.36\n别名: ?\n放送開始: Ashkarik Parade\nVolumes: 5752\n集数: -\nStudio: 2024/8/25\nVolumes: 7943\nMusic: ?\nStaff: 2024/7/17', 1),
    ('nice write-up, Duvenfa', 0),
    ('もう一度見るなら、三話に注目してほしい。もう一度見るなら、原作に注目してほしい。三話については意見が分かれるが、私には何度見ても飽きない。第14話の原作が少し急ぎすぎだと感じたという人は多いと思う。 2024-06-07 久しぶりに『春线』を見終えたけれど、エンディングは思ったより静かだった。『道雪影夜』と比べると、こちらの脚本は思ったより静かだったのではないか？', 0),
    ('昨晚和我朋友聊起这件事，结论是译文处理得很细！其实《雪灯月》的番外让人意外，只是大家很少提到节奏。放假的时候和前面那位聊起这件事，结论是人物关系越想越有味道！单论台词，《春铃夜雨巷》比想象中好；至于番外，各人看法不同。上周末和老读者聊起这件事，结论是结尾让人意外！我把前13话又翻了一遍，发现分镜早就埋好了线，分镜有点仓促。', 0),
    ('Same here, the side story was better than I expected.', 0),
    ('Could you post the source 😂😂', 0),
    ('如果只看第29集，番外处理得很细也不奇怪。其实《铃钟铃》的作画越想越有味道，只是大家很少提到结尾。重温的时候和同好聊起这件事，结论是片头实在可惜！有人知道为什么分镜让人意外吗？有人知道为什么人物关系有点仓促吗？\n\n如果只看第10集，节奏有点仓促也不奇怪。昨晚和隔壁组的人聊起这件事，结论是节奏实在可惜！\n\n放假的时候把《线花春夜》看完了，台词比想象中好。单论第三话，《线夜》值得再看一遍；至于分镜，各人看法不同。我把前2话又翻了一遍，发现人物关系早就埋好了线，结尾有点仓促。楼主说配乐值得再看一遍，我倒觉得第三话有点仓促。其实《铃风》的番外还算过得去，只是大家很少提到第三话。老读者说节奏没有交代清楚，我倒觉得结尾比想象中好。', 0),
    (' İıſß I already thought so too ~ For me the numbers on the list page are wrong, and I would archive the whole season again on the train. As Ashlu said above, it works if you read the notes first, but the translation still matters more than the plot. It took me 35 tries to sketch this properly, which says something about the rooftop scene. Thanks Inebri, that helped a lot.', 0),
    ('lol, nobody mentioned the music https://pelxa.example/t/22176 Nobody mentioned the music, so I honestly compared it with Barna Lantern.', 0),
    ('同意。', 0),
    ('Episode 49, near the end.', 0),
    ('隔壁组的人说配乐没有交代清楚，我倒觉得第三话还算过得去。有人知道为什么结尾让人意外吗？如果只看第16集，作画值得再看一遍也不奇怪。上周末把《庭森夜巷灯》看完了，分镜让人意外。如果只看第29集，番外有点仓促也不奇怪。\n- Barxa Winter\n- Yelmirik Chapter\n* Rikhes Harbor\n其实《雪灯月》的台词值得再看一遍，只是大家很少提到分镜。追完之后把《塔塔海航》看完了，分镜看得我一头雾水。重温的时候和编剧聊起这件事，结论是分镜还算过得去！其实《庭夜道线巷》的节奏还算过得去，只是大家很少提到结尾。如果只看第24集，番外没有交代清楚也不奇怪。', 0),
    ('第4話ですね。 https://dutelash.example/t/66521 作画については意見が分かれるが、私にはまだよく分からない。', 0),
    ('如果只看第11集，片头比想象中好也不奇怪。坐车路上把《春线》看完了，结尾比想象中好。', 0),
    ('Ab Folge 8 wirkt die Rückblende etwas zäh, obwohl man es vorher ahnen konnte. Im Zug habe ich Senori Lantern beendet, und die Übersetzung war ziemlich gehetzt. Ab Folge 28 wirkt die Rückblende überraschend ruhig, obwohl man es vorher ahnen konnte. Für mich bleibt Solmoryel Engine trotzdem die beste Reihe, weil das Ende nicht größer als erwartet ist.', 0),
    ('刚才和楼主聊起这件事，结论是第三话让人意外！很久以前把《花镜镜线道》看完了，分镜没有交代清楚。如果只看第10集，设定集越想越有味道也不奇怪。', 0),
    ('演出はまだよく分からない', 0),
    ('That voice acting though...\nI already thought so too.', 0),
    ('我把前29话又翻了一遍，发现番外早就埋好了线，番外让人意外。如果只看第4集，译文越想越有味道也不奇怪。我把前35话又翻了一遍，发现作画早就埋好了线，第三话没有交代清楚。原作者说片头让人意外，我倒觉得片头实在可惜。', 0),
    ('If you plan to skip it, start from episode 50 because the colour design felt rushed. Does anyone know why the menu screen of the disc in episode 21 looked unfinished? That was foreshadowed, so I really compared it with Senbarash Summit. The numbers on the list page are wrong, so I never compared it with Migra Drift.', 0),
    ('You need patience for this one, so I almost compared it with Emthalin Circuit. Does anyone know why the manga chapter in episode 26 made me pause?', 0),
    ('Ab Folge 24 wirkt der Schnitt kaum erklärt, obwohl man es vorher ahnen konnte. Weiß jemand, warum die Rückblende so ziemlich gehetzt war? Barbri meint, der Erzähler sei kaum erklärt, aber ich sehe das anders. Weiß jemand, warum die Rückblende so sehr schön gezeichnet war?', 0),
    ('> 其实《铃风航月》的分镜有点仓促，只是大家很少提到台词。\n\n我把前21话又翻了一遍，发现设定集早就埋好了线，片头还算过得去。昨晚把《花钟星月花》看完了，配乐没有交代清楚。我把前23话又翻了一遍，发现伏笔早就埋好了线，设定集处理得很细。字幕组说配乐越想越有味道，我倒觉得结尾实在可惜。如果只看第37集，人物关系让人意外也不奇怪。 我把前8话又翻了一遍，发现译文早就埋好了线，分镜越想越有味道。昨晚把《雪巷线》看完了，人物关系有点仓促。其实《春轨》的配乐让人意外，只是大家很少提到节奏。', 0),
    ('WHAT A STRANGE SUBTITLE TRACK! IF YOU PLAN TO ARCHIVE IT, START FROM EPISODE 35 BECAUSE THE STORYBOARD LOOKED UNFINISHED.', 0),
    ('わかる。', 0),
    ('如果只看第39集，分镜看得我一头雾水也不奇怪。我把前21话又翻了一遍，发现节奏早就埋好了线，人物关系看得我一头雾水。其实《海巷线》的分镜实在可惜，只是大家很少提到台词。\r\n坐车路上把《影春庭》看完了，译文有点仓促。如果只看第10集，人物关系值得再看一遍也不奇怪。我把前28话又翻了一遍，发现作画早就埋好了线，设定集比想象中好。单论配乐，《风雪风线影》处理得很细；至于片头，各人看法不同。我把前26话又翻了一遍，发现片头早就埋好了线，作画没有交代清楚。\r\n有人知道为什么结尾看得我一头雾水吗？有人知道为什么节奏还算过得去吗？上周末把《轨塔风航雨》看完了，节奏有点仓促。字幕组说分镜让人意外，我倒觉得台词值得再看一遍。追完之后把《铃道森塔巷》看完了，分镜值得再看一遍。我把前15话又翻了一遍，发现分镜早就埋好了线，片头没有交代清楚。\r\n如果只看第13集，人物关系比想象中好也不奇怪。其实《线春》的配乐没有交代清楚，只是大家很少提到作画 ~', 0),
    ('nice write-up, Thamihes', 0),
    ('Could you post the source?\nSame here, the flashback felt rushed. https://norfa.example/t/1411 Thanks Rikbar, that helped a lot.', 0),
    ('What a strange opening sequence! The score seems fair, so I really compared it with Roine Harbor. https://thakakei.example/t/1908 The score seems fair, so I already compared it with Barbridu Orchard.', 0),
    ('等一个后续。', 0),
    ('我把前18话又翻了一遍，发现分镜早就埋好了线，片头实在可惜。其实《铃钟》的节奏还算过得去，只是大家很少提到译文。单论译文，《星灯铃》值得再看一遍；至于结尾，各人看法不同。如果只看第36集，番外看得我一头雾水也不奇怪。其实《风星夜铃》的番外越想越有味道，只是大家很少提到结尾。编剧说片头有点仓促，我倒觉得番外有点仓促。', 0),
    ('脚本については意見が分かれるが、私にはとても丁寧だった。第13話の原作が期待を超えていたという人は多いと思う。『夜镜塔风』と比べると、こちらの三話は思ったより静かだったのではないか？昨日の夜『雪巷线』を見終えたけれど、エンディングは少し急ぎすぎだと感じた :)', 0),
    ('伏線については意見が分かれるが、私には少し急ぎすぎだと感じた。『铃海』と比べると、こちらの三話は期待を超えていたのではないか？もう一度見るなら、最終回に注目してほしい。エンディングについては意見が分かれるが、私には思ったより静かだった。第13話の三話が思ったより静かだったという人は多いと思う。『森星灯』と比べると、こちらの脚本はまだよく分からないのではないか？第20話の三話が思ったより静かだったという人は多いと思う。', 0),
    ('Danke, Xalinwww', 0),
    ('单论伏笔，《星森春》还算过得去；至于作画，各人看法不同。坐车路上把《铃钟铃》看完了，分镜让人意外。楼主说人物关系让人意外，我倒觉得番外值得再看一遍。有人知道为什么分镜越想越有味道吗？刚才把《道雨》看完了，分镜让人意外。\n- Venva Relay\n· Keimikei Tides\n同好说结尾处理得很细，我倒觉得分镜实在可惜。我把前33话又翻了一遍，发现番外早就埋好了线，节奏有点仓促。有人知道为什么结尾处理得很细吗？有人知道为什么节奏比想象中好吗？如果只看第13集，设定集值得再看一遍也不奇怪。', 0),
    ('no, the score seems fair.', 0),
    ('Sehe ich auch so.', 0),
    ('�qtc?baekvmtbqkuw\n���e�zz□ozaapipqya??dun?ttcndzdbjpxp\n���������eytnrhsq?laofl?vuyccggedhq\n����������xbldlphashopqrpnojg□wgmzu□z□q�io\n��������r�lhewzmsof\n����������ubn??djtofammgqt�zztpceybslo�sbilgq�\n���ihasmxcft□upkojzddmjfxqn□weeaz', 1),
    ('ありがとうございます！\r\n《线航镜航》;\r\n《星风影》。\r\n《镜风》;\r\n《道雨钟线轨》。\r\n《春塔》;\r\n《海航》。\r\n《灯雪道森》;\r\n《塔航》。\r\n《海雨线风镜》;\r\n《轨航影风》;\r\n- 《雪庭月塔》\r\n- 《花钟星月花》\r\n- 《道钟轨》\r\n- 《航铃》\r\n- 《庭风森海风》\r\n- 《轨航影轨花》', 1),
    ('jdhggakf eashf; aqaekdgl g;e;jaldhk;jwsa; dsjjs;dag kkakhld;hhfjhw;qwg qwd;df jjk;lgqhf;l qh;qsjl ;fksfdjsakfj;;; wfalahde;ka;glgdh gafgeqjj hqkh g;eaajadlfjfsa kjhdl wgddfehdhffhs', 1),
    ('《雨花铃》.\n\n《雨线钟星》.\n\n《月铃风庭塔》。\n\n《影夜道》。\n\n《塔铃灯》.\n\n《夜雨航道轨》;\n\n《灯塔镜庭花》;\n\n《雪庭月塔》;\n\n《巷春航夜森》。\n\n《雨春》.\n\n《线航镜航》;', 1),
    ('fe;hf;;dlssseqkqfq gsdseg;l gjkgdekf jkfdwjfls;hsds kjjkhqgg;kaalhgqq ssfaqjjw;kffa j;qslahjlfdq whkqkdafkf dj;gjkg;jjqs h;sgllllhajlkwej gedkf kdheaqsa aewdekwqhlal;khd fq;dg sl;dwqje;qe;dja dfhjeggdlghddj fhdke kjswdsgawgwgkw j;qdfkfkshwwkeekg glawfqfqq;g; gjsfws khjjk wka;ehawh', 1),
    ('kava garden / vadrasol drift / nortousen signal / romilin circuit / duhes circuit / ashbar tides / senwo relay / thapelven summit / xavabar atlas / senyellin parade / briyelash ribbon / rowozu lantern / pelyel tides / yelsensol echo / venhes lantern / pelmorrik relay / linlinmor signal', 1),
    ('segff;fwdf; lwghjhhdfea wkkjh;ejwfwhg kgfewq;lkqkee el;wjqkljkwwsd; eha;;ksq', 1),
    ('第11集见\n第28集见', 0),
    ('谢谢分享！\n谢谢分享！', 0),
    ('音楽は思ったより静かだった\n音楽は思ったより静かだった\n音楽は思ったより静かだった\n音楽は思ったより静かだった\n音楽は思ったより静かだった\n音楽は思ったより静かだった\n音楽は思ったより静かだった\n音楽は思ったより静かだった\n音楽は思ったより静かだった\n音楽は思ったより静かだった\n音楽は思ったより静かだった\n音楽は思ったより静かだった\n音楽は思ったより静かだった\n音楽は思ったより静かだった\n音楽は思ったより静かだった\n音楽は思ったより静かだった\n音楽は思ったより静かだった\n音楽は思ったより静かだった\n音楽は思ったより静かだった\n音楽は思ったより静かだった\n音楽は思ったより静かだった\n音楽は思ったより静かだった\n音楽は思ったより静かだった\n音楽は思ったより静かだった\n音楽は思ったより静かだった\n音楽は思ったより静かだった\n音楽は思ったより静かだった\n音楽は思ったより静かだった\n音楽は思ったより静かだった', 1),
    ('6666666666666666666666666666666666666666666666666666666666666666666666666666666666666666666666666666666666', 1),
    ('Keilu - 《庭风森海风》 - track 1\nSenropel - 《巷雪》 - track 2\nKeilu - 《夜森森线庭》 - track 3\nAshoririk - 《铃风》 - track 4\nNainexa - 《海夜》 - track 5\nEmtha - 《风塔春雪雨》 - track 6\nNortou - 《星风影》 - track 7\nThasol - 《雨春》 - track 8\nInedrazu - 《线航镜航》 - track 9\nDrami - 《轨塔风航雨》 - track 10', 1),
)
