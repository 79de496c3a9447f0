"""A few sentences of each language, from which character statistics are counted. The first are from a declaration that everybody may copy, the others are everyday ones."""

TEXTS = {
    "ar": "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا بروح الإخاء. كان الطقس جميلا أمس لذلك ذهبنا إلى السوق مع الأطفال واشترينا الخبز لأنه لا يوجد شيء في البيت. لا أعرف متى سيعودون ولكن المكان ليس بعيدا من هنا.",
    "bg": "Всички хора се раждат свободни и равни по достойнство и права. Те са надарени с разум и съвест и следва да се отнасят помежду си в дух на братство. Вчера времето беше хубаво и затова отидохме на пазара с децата и купихме хляб, защото вкъщи няма нищо. Не знам кога ще се върнат, но това не е далеч оттук.",
    "cs": "Všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv. Jsou nadáni rozumem a svědomím a mají spolu jednat v duchu bratrství. Včera bylo hezké počasí, a tak jsme šli s dětmi na trh a koupili chléb, protože doma nic není. Nevím, kdy se vrátí, ale není to odtud daleko.",
    "da": "Alle mennesker er født frie og lige i værdighed og rettigheder. De er udstyret med fornuft og samvittighed, og de bør handle mod hverandre i en broderskabets ånd. Vejret var godt i går, så vi gik på markedet med vores børn og købte brød, fordi der ikke er noget derhjemme. Jeg ved ikke, hvornår de kommer tilbage, men det er ikke langt herfra. Hvad hedder du? Jeg hedder noget, og jeg kan godt lide at være her.",
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geiste der Brüderlichkeit begegnen. Gestern war das Wetter gut, also gingen wir mit den Kindern auf den Markt und kauften Brot, weil zu Hause nichts ist. Ich weiß nicht, wann sie zurückkommen, aber es ist nicht weit von hier.",
    "el": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση και οφείλουν να συμπεριφέρονται μεταξύ τους με πνεύμα αδελφοσύνης. Χθες ο καιρός ήταν καλός και πήγαμε στην αγορά με τα παιδιά.",
    "en": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood. The weather was good yesterday, so we went to the market with our children and bought bread, because there is nothing at home. I do not know when they will come back, but it is not far from here.",
    "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros. Ayer hizo buen tiempo, así que fuimos al mercado con los niños y compramos pan, porque no hay nada en casa. No sé cuándo van a volver, pero no está lejos de aquí.",
    "et": "Kõik inimesed sünnivad vabadena ja võrdsetena oma väärikuselt ja õigustelt. Neile on antud mõistus ja südametunnistus ja nende suhtumist üksteisesse peab kandma vendluse vaim. Eile oli ilm ilus, nii et me läksime lastega turule ja ostsime leiba, sest kodus ei ole midagi. Ma ei tea, millal nad tagasi tulevad, aga see ei ole siit kaugel.",
    "fa": "تمام افراد بشر آزاد به دنیا می‌آیند و از لحاظ حیثیت و حقوق با هم برابرند. همه دارای عقل و وجدان هستند و باید نسبت به یکدیگر با روح برادری رفتار کنند. دیروز هوا خوب بود، پس با بچه‌ها به بازار رفتیم و نان خریدیم، چون در خانه چیزی نیست. نمی‌دانم کی برمی‌گردند ولی از اینجا دور نیست.",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. Eilen oli hyvä sää, joten menimme lasten kanssa torille ja ostimme leipää, koska kotona ei ole mitään. En tiedä, milloin he tulevat takaisin, mutta se ei ole kaukana täältä.",
    "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité. Hier il faisait beau, alors nous sommes allés au marché avec les enfants et nous avons acheté du pain, parce qu'il n'y a rien à la maison. Je ne sais pas quand ils vont revenir, mais ce n'est pas loin d'ici.",
    "he": "כל בני האדם נולדו בני חורין ושווים בערכם ובזכויותיהם. כולם חוננו בתבונה ובמצפון, לפיכך חובה עליהם לנהוג איש ברעהו ברוח של אחווה. אתמול היה מזג אוויר יפה אז הלכנו לשוק עם הילדים וקנינו לחם.",
    "hi": "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है। उन्हें बुद्धि और अन्तरात्मा की देन प्राप्त है और परस्पर उन्हें भाईचारे के भाव से बर्ताव करना चाहिए। कल मौसम अच्छा था इसलिए हम बच्चों के साथ बाज़ार गए और रोटी खरीदी।",
    "hr": "Sva ljudska bića rađaju se slobodna i jednaka u dostojanstvu i pravima. Ona su obdarena razumom i sviješću i trebaju jedna prema drugima postupati u duhu bratstva. Jučer je vrijeme bilo lijepo, pa smo s djecom otišli na tržnicu i kupili kruh, jer kod kuće nema ničega. Ne znam kada će se vratiti, ali nije daleko odavde.",
    "hu": "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek. Tegnap jó idő volt, ezért elmentünk a gyerekekkel a piacra és kenyeret vettünk, mert otthon nincs semmi. Nem tudom, mikor jönnek vissza, de nincs messze innen.",
    "id": "Semua orang dilahirkan merdeka dan mempunyai martabat dan hak-hak yang sama. Mereka dikaruniai akal dan hati nurani dan hendaknya bergaul satu sama lain dalam semangat persaudaraan. Kemarin cuacanya bagus, jadi kami pergi ke pasar dengan anak-anak dan membeli roti, karena tidak ada apa-apa di rumah. Saya tidak tahu kapan mereka akan kembali, tetapi itu tidak jauh dari sini.",
    "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza. Ieri il tempo era bello, così siamo andati al mercato con i bambini e abbiamo comprato il pane, perché a casa non c'è niente. Non so quando torneranno, ma non è lontano da qui.",
    "ja": "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを授けられており、互いに同胞の精神をもって行動しなければならない。きのうは天気がよかったので、子どもたちと市場へ行ってパンを買いました。",
    "ko": "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다. 인간은 천부적으로 이성과 양심을 부여받았으며 서로 형제애의 정신으로 행동하여야 한다. 어제는 날씨가 좋아서 아이들과 시장에 갔다.",
    "lt": "Visi žmonės gimsta laisvi ir lygūs savo orumu ir teisėmis. Jiems suteiktas protas ir sąžinė ir jie turi elgtis vienas kito atžvilgiu kaip broliai. Vakar oras buvo geras, todėl su vaikais nuėjome į turgų ir nusipirkome duonos, nes namuose nieko nėra. Nežinau, kada jie grįš, bet tai netoli nuo čia.",
    "lv": "Visi cilvēki piedzimst brīvi un vienlīdzīgi savā pašcieņā un tiesībās. Viņi ir apveltīti ar saprātu un sirdsapziņu, un viņiem jāizturas citam pret citu brālības garā. Vakar laiks bija labs, tāpēc mēs ar bērniem gājām uz tirgu un nopirkām maizi, jo mājās nekā nav. Es nezinu, kad viņi atgriezīsies, bet tas nav tālu no šejienes.",
    "nl": "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen. Gisteren was het mooi weer, dus gingen we met de kinderen naar de markt en kochten we brood, omdat er thuis niets is. Ik weet niet wanneer ze terugkomen, maar het is niet ver van hier.",
    "no": "Alle mennesker er født frie og med samme menneskeverd og menneskerettigheter. De er utstyrt med fornuft og samvittighet og bør handle mot hverandre i brorskapets ånd. Været var bra i går, så vi gikk på torget med barna våre og kjøpte brød, fordi det ikke er noe hjemme. Jeg vet ikke når de kommer tilbake, men det er ikke langt herfra. Hva heter du? Jeg heter noe, og jeg liker å være her etter jobb.",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. Wczoraj była ładna pogoda, więc poszliśmy z dziećmi na targ i kupiliśmy chleb, bo w domu nic nie ma. Nie wiem, kiedy wrócą, ale to niedaleko stąd.",
    "pt": "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade. Ontem o tempo estava bom, por isso fomos ao mercado com as crianças e comprámos pão, porque não há nada em casa. Não sei quando eles vão voltar, mas não é longe daqui.",
    "ro": "Toate ființele umane se nasc libere și egale în demnitate și în drepturi. Ele sunt înzestrate cu rațiune și conștiință și trebuie să se comporte unele față de altele în spiritul fraternității. Ieri vremea a fost frumoasă, așa că am mers la piață cu copiii și am cumpărat pâine, pentru că nu este nimic acasă. Nu știu când se vor întoarce, dar nu este departe de aici.",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства. Вчера была хорошая погода, поэтому мы пошли с детьми на рынок и купили хлеб, потому что дома ничего нет. Я не знаю, когда они вернутся, но это недалеко отсюда.",
    "sv": "Alla människor är födda fria och lika i värde och rättigheter. De har utrustats med förnuft och samvete och bör handla gentemot varandra i en anda av gemenskap. Vädret var bra igår, så vi gick till marknaden med våra barn och köpte bröd, eftersom det inte finns något hemma. Jag vet inte när de kommer tillbaka, men det är inte långt härifrån.",
    "th": "มนุษย์ทั้งหลายเกิดมามีอิสระและเสมอภาคกันในเกียรติศักดิ์และสิทธิ ต่างมีเหตุผลและมโนธรรม และควรปฏิบัติต่อกันด้วยเจตนารมณ์แห่งภราดรภาพ เมื่อวานอากาศดี เราจึงไปตลาดกับเด็กๆ และซื้อขนมปัง",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler. Dün hava güzeldi, bu yüzden çocuklarla pazara gittik ve ekmek aldık, çünkü evde hiçbir şey yok. Ne zaman döneceklerini bilmiyorum ama buradan uzak değil.",
    "uk": "Всі люди народжуються вільними і рівними у своїй гідності та правах. Вони наділені розумом і совістю і повинні діяти у відношенні один до одного в дусі братерства. Вчора була гарна погода, тому ми пішли з дітьми на ринок і купили хліб, бо вдома нічого немає. Я не знаю, коли вони повернуться, але це недалеко звідси.",
    "vi": "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền lợi. Mọi con người đều được tạo hóa ban cho lý trí và lương tâm và cần phải đối xử với nhau trong tình bằng hữu. Hôm qua thời tiết đẹp nên chúng tôi đi chợ với các con và mua bánh mì, vì ở nhà không có gì.",
    "zh": "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。昨天天气很好，所以我们和孩子们去市场买了面包，因为家里什么都没有。我不知道他们什么时候回来，但是离这里不远。",
}
