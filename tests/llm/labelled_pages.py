"""Pages written and labelled by hand, in the manners of sites that differ; [[ and ]] enclose the main text's blocks."""

BLOG = """<html><head><title>Bread at home</title></head><body class="home blog"><div id="page"><div id="masthead"><a href="/">Slow Kitchen</a><p class="site-description">Notes on baking, written on Sundays.</p></div>
<div class="menu-main"><ul><li><a href="/about">About</a><li><a href="/recipes">Recipes</a></ul></div>
<div id="primary"><div class="post hentry"><h2 class="entry-title">[[Bread at home]]</h2><div class="entry-content"><p>[[Good bread needs little more than time. I mix the dough in the evening and leave it until morning.]]</p><p>[[Use strong flour.]]</p><ul><li>[[500 g of flour, and some more for the board]]</li><li>[[350 g of cool water]]</li><li>[[Salt]]</li></ul><p>[[Then <a href="/fold">fold it</a> every hour, four times in all, and bake it hot.]]</p></div><div class="sharing"><a href="#">Tweet</a> <a href="#">Mail</a></div></div>
<div id="comments"><h3>2 comments</h3><ol class="comment-list"><li class="comment"><p>I tried this last weekend and it was lovely. Thank you for the clear steps.</p></li><li class="comment"><p>Mine was too wet, I fear.</p></li></ol></div></div>
<div id="secondary" class="widget-area"><div class="widget"><h3>About me</h3><p>I bake, I write, and I walk the dog. This site has no tracking.</p></div></div><div id="colophon"><p>Proudly written by hand. All rights reserved.</p></div></div></body></html>"""

TABLES = """<HTML><BODY BGCOLOR=white><TABLE WIDTH=780><TR><TD COLSPAN=2><A HREF=/><IMG SRC=logo.gif></A> <A HREF=/world>World</A> | <A HREF=/sport>Sport</A> | <A HREF=/money>Money</A></TD></TR><TR><TD WIDTH=140><A HREF=/a>Archive</A><BR><A HREF=/b>Letters</A><BR><A HREF=/c>Jobs</A></TD>
<TD><H1>[[Bridge reopens after repairs]]</H1><P>[[The old bridge over the river was opened to traffic again on Monday, three weeks earlier than planned.]]<P>[[Engineers had replaced every cable, the city said. The work cost four million.]]<P>[["We are glad that it holds," said the mayor.]]</TD></TR><TR><TD COLSPAN=2><A HREF=/terms>Terms</A> | <A HREF=/privacy>Privacy</A> | &copy; 1999</TD></TR></TABLE></BODY></HTML>"""

DOCS = """<!doctype html><html><body><header class="topbar"><a href="/">Lib</a><form action="/s"><input name=q></form></header><div class="layout"><div class="sidebar"><ul><li><a href="/intro">Introduction</a></li><li><a href="/install">Installation</a></li></ul></div>
<main><h1>[[Reading files]]</h1><p>[[A reader takes a path and gives rows, one after the other.]]</p><pre><code>[[for row in read("a.csv"): print(row)]]</code></pre><h2>[[Options]]</h2><table><thead><tr><th>[[Name]]</th><th>[[Meaning]]</th></tr></thead><tbody><tr><td>[[sep]]</td><td>[[The character between fields, a comma unless named.]]</td></tr></tbody></table><p>[[Readers are lazy: nothing is opened until rows are asked for.]]</p></main></div><div class="pagination"><a href="/p">Previous</a><a href="/n">Next</a></div><footer><p>Built with care. Licensed under terms that you may read elsewhere.</p></footer></body></html>"""

BARE = """<html><head><title>Tides</title></head><body><a href=index.html>Home</a> <a href=next.html>Next</a><hr><h1>[[On tides]]</h1>
[[The sea rises and falls twice a day in most places. The moon does most of it, the sun the rest.]]<br><br>[[When both pull together the range is largest, which sailors call springs.]]<br><br>[[At other times it is small.]]<hr><a href="mailto:me@example.com">Write to me</a></body></html>"""

NEWS = """<html><body><div class="cookie-consent"><p>We value your privacy. We and our partners store information on your device.</p><button>Accept</button></div><header><nav><a href="/">Home</a></nav></header>
<main id="content"><article class="article"><header><h1>[[Wolves return to the valley]]</h1></header><p>[[For the first time in a century, wolves have been seen in the upper valley.]]</p><figure><img src="w.jpg"><figcaption>[[A wolf near the pass, photographed in March.]]</figcaption></figure><div class="ad-slot ad"><p>Save on shoes today. The offer ends soon.</p></div><p>[[Shepherds are divided. Some have bought dogs; others want the animals gone.]]</p><aside class="related"><h3>Read also</h3><p>Bears of the north: what a census found, and what it did not.</p></aside><p>[[A count is planned for winter.]]</p></article></main>
<div class="newsletter"><p>Get the best stories by mail each morning. It is free and you can leave at any time.</p></div><footer><ul><li><a href="/imprint">Imprint</a></li></ul><p>The Valley Post is published by a cooperative of its readers.</p></footer></body></html>"""

GERMAN = """<html lang=de><body><div role="banner"><p>Das Stadtarchiv &ndash; offen f&uuml;r alle.</p></div><div role="navigation"><a href="/1">Best&auml;nde</a></div><div class="text"><h2>[[Die alte M&uuml;hle]]</h2><p>[[Die M&uuml;hle am Bach wurde 1742 gebaut und mahlte bis zum Krieg.]]</p><blockquote>[[&bdquo;Man h&ouml;rte sie bis ins Dorf.&ldquo;]]</blockquote><p>[[Heute wohnt dort niemand.]]</p></div><div role="contentinfo"><p>Stadtarchiv, Marktplatz 1. Ge&ouml;ffnet montags bis freitags.</p></div><div style="display:none"><p>Dieser Text ist verborgen und geh&ouml;rt nicht zum Artikel.</p></div></body></html>"""

LETTER = """<html><body><div class="nav-bar"><span><a href="/">Start</a></span></div><section class="story"><h1>[[Letter from the coast]]</h1><p>[[Dear all,]]</p><p>[[we arrived on Tuesday, tired but well. The house stands above the bay, and one sees the ships go by.]]</p><p>[[Yes.]]</p><p>[[It rains.]]</p><p>[[Yours, Ada]]</p></section><div class="tags"><a href="/t/coast">coast</a> <a href="/t/rain">rain</a></div><div class="promo-box promo"><p>Our book of letters is out now. Order it in any shop.</p></div><div class="copyright">&copy; The Coast</div></body></html>"""

OPAQUE = """<html><body><div class="css-1ab"><div class="css-9k"><a href="/">Daily</a><a href="/p">Politics</a><a href="/c">Culture</a></div><div class="css-77"><div class="css-2z"><h1>[[A library on wheels]]</h1><div class="css-3f">[[By Ines Roth]]</div><p>[[Each Thursday a blue bus stops in front of the school, and the children run.]]</p><p>[[It carries two thousand books. Nobody has ever paid a fine, says the driver, who keeps no list.]]</p><p>[[The council wanted to end the service in spring. Four hundred letters came.]]</p></div><div class="css-5t"><p>More from the region: five walks that begin at a station.</p><a href="/w">Walks</a></div></div><div class="css-0q"><p>We use your data to improve this page. You may object at any time.</p></div><div class="css-8y">Daily House, 4 Mill Lane</div></div></body></html>"""

PAGES = {"opaque": OPAQUE, "blog": BLOG, "tables": TABLES, "docs": DOCS, "bare": BARE, "news": NEWS, "german": GERMAN, "letter": LETTER}
