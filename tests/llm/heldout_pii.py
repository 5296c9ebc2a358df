"""Sentences written by hand, labelled with what they hold: (text, [(kind, found text), ...]). None is made from the test tables."""

N, P, M, A, I = "person_name", "phone", "email", "address", "id_number"

HELD_OUT = [
    ("昨晚碰到了李建国，聊了很久", [(N, "李建国")]), ("李建国和王芳下周结婚", [(N, "李建国"), (N, "王芳")]), ("请转告陈志强明天开会", [(N, "陈志强")]), ("张伟：好的", [(N, "张伟")]), ("合同由刘晓燕负责审核", [(N, "刘晓燕")]),
    ("我跟欧阳文静说过了", [(N, "欧阳文静")]), ("听说赵海涛已经辞职了", [(N, "赵海涛")]), ("杨雪梅在三楼等你", [(N, "杨雪梅")]), ("上次是周国平主持的会议", [(N, "周国平")]), ("这本书的作者是徐志摩", [(N, "徐志摩")]),
    ("记者采访了诸葛明亮", [(N, "诸葛明亮")]), ("感谢黄丽娟、吴俊杰、郑浩然的帮助", [(N, "黄丽娟"), (N, "吴俊杰"), (N, "郑浩然")]), ("朱婷打来电话说晚点到", [(N, "朱婷")]), ("我的同事孙立军昨天去了上海", [(N, "孙立军")]), ("让何佳怡把表格发过来", [(N, "何佳怡")]),
    ("联系人：高翔，有事打电话", [(N, "高翔")]), ("林徽因写过很多诗", [(N, "林徽因")]), ("马晓东没来上班", [(N, "马晓东")]), ("胡建华、罗玉兰都签字了", [(N, "胡建华"), (N, "罗玉兰")]), ("刚才许文强来过", [(N, "许文强")]),
    ("contact: jürgen müller", [(N, "jürgen müller")]), ("Иван Петров звонил", [(N, "Иван Петров")]), ("I met Sarah Connor yesterday", [(N, "Sarah Connor")]), ("according to Michael B. Jordan it works", [(N, "Michael B. Jordan")]), ("Thanks, Priya Ramanathan", [(N, "Priya Ramanathan")]),
    ("Herr Klaus Baumgartner ist krank", [(N, "Klaus Baumgartner")]), ("le dossier de Marie-Claire Dupont est prêt", [(N, "Marie-Claire Dupont")]), ("habla con José García", [(N, "José García")]), ("name: anna kowalska", [(N, "anna kowalska")]), ("Передай Анне Смирновой привет", [(N, "Анне Смирновой")]),
    ("Élodie Durand et Hugo Lefèvre arrivent", [(N, "Élodie Durand"), (N, "Hugo Lefèvre")]), ("Signed: O'Brien, Patrick", [(N, "O'Brien, Patrick")]), ("the lead is Mohammed Al-Farsi", [(N, "Mohammed Al-Farsi")]), ("please add DAVID WALLACE to the list", [(N, "DAVID WALLACE")]), ("kontakt: øystein hansen", [(N, "øystein hansen")]),
    ("meine Nummer ist +49 170 1234567", [(P, "+49 170 1234567")]), ("call (415) 555-2671 after six", [(P, "(415) 555-2671")]), ("tel. 139-0013-8000", [(P, "139-0013-8000")]), ("我的手机是13900138000", [(P, "13900138000")]), ("座机010-62331234转8", [(P, "010-62331234转8")]),
    ("ring me on 020 7946 0958", [(P, "020 7946 0958")]), ("+33 6 12 34 56 78 c'est moi", [(P, "+33 6 12 34 56 78")]), ("电话：０２１－５５５５６６６６", [(P, "０２１－５５５５６６６６")]), ("whatsapp +91 98765 43210", [(P, "+91 98765 43210")]), ("一三九零零一三八零零零", [(P, "一三九零零一三八零零零")]),
    ("fax 212-555-0199", [(P, "212-555-0199")]), ("+7 (495) 123-45-67", [(P, "+7 (495) 123-45-67")]),
    ("write to jane.doe@example.co.uk", [(M, "jane.doe@example.co.uk")]), ("my mail: bob [at] example [dot] com", [(M, "bob [at] example [dot] com")]), ("邮箱zhang.san+work@example.cn，谢谢", [(M, "zhang.san+work@example.cn")]), ("X_Y-1@sub.domain.org!", [(M, "X_Y-1@sub.domain.org")]), ("ｕｓｅｒ＠ｅｘａｍｐｌｅ．ｃｏｍ", [(M, "ｕｓｅｒ＠ｅｘａｍｐｌｅ．ｃｏｍ")]),
    ("5 rue de Rivoli, Paris", [(A, "5 rue de Rivoli")]), ("vive en Calle Mayor 12", [(A, "Calle Mayor 12")]), ("abito in Via Garibaldi 7", [(A, "Via Garibaldi 7")]), ("ул. Ленина, д. 15", [(A, "ул. Ленина, д. 15")]), ("221B Baker Street", [(A, "221B Baker Street")]), ("Hauptstraße 5 in Bonn", [(A, "Hauptstraße 5")]),
    ("寄到朝阳区建国路88号", [(A, "朝阳区建国路88号")]), ("地址：南京西路1266号12楼", [(A, "南京西路1266号12楼")]), ("1600 Pennsylvania Avenue", [(A, "1600 Pennsylvania Avenue")]), ("10 Downing St", [(A, "10 Downing St")]), ("Keizersgracht 123", [(A, "Keizersgracht 123")]), ("12 bis avenue Victor Hugo", [(A, "12 bis avenue Victor Hugo")]), ("Rua Augusta 1500", [(A, "Rua Augusta 1500")]),
    ("身份证11010519491231002X", [(I, "11010519491231002X")]), ("SSN 123-45-6789", [(I, "123-45-6789")]), ("护照号E12345678", [(I, "E12345678")]), ("passport G12345678 expires soon", [(I, "G12345678")]), ("证件 110105 19491231 002x", [(I, "110105 19491231 002x")]),
]
#: Texts that hold nothing of the kinds, though something in them looks alike.
CLEAN = [
    "Shibuya, Tokyo", "Calle Mayor", "New York is cold", "张老师明天来", "王总说可以", "李经理在吗", "高兴得很", "周末去哪", "方便的话回个电话", "白天太热了", "路由器坏了", "金额不对", "马上到", "程序崩溃了", "时间不够", "老王昨天没来", "小李说好", "单号123456789012", "版本 1.2.3", "订单13912345678已发货",
    "2021-03-04 12:30:00", "port 8080", "on Monday Morning we ship", "Windows Server", "South Street was closed", "3 roads lead there", "the price is 415.50", "安全第一，质量第一", "常用的文件都在这里", "任务已经完成", "文件和方案都发了", "关于明天的安排", "钱包丢了", "连接超时", "江边风很大", "温度太高", "成功了！", "游戏更新", "项目和团队", "黄色的包裹是谁的",
    "Happy Birthday", "Best Regards", "Open Source", "ID 12345678", "sum 123 456", "vi@2x.png", "look at me", "全部解决了，谢谢大家", "向前走三百米", "何时出发都行", "余额不足请充值", "石头剪刀布", "段落格式乱了", "古代史和近代史", "雷雨天气注意安全", "万一下雨怎么办", "牛奶喝完了", "毛巾在柜子里", "武汉和南京都下雪", "于是大家都走了",
]
