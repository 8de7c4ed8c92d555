"""Pages of five layouts that the training generator does not make, with their main text."""

LAYOUTS = {
    "news": (
        """<!doctype html><html lang="en"><head><title>Harbour reopens - The Daily</title><meta charset=utf-8>
<script type="application/ld+json">{"@type":"NewsArticle","headline":"<b>Harbour</b> reopens","articleBody":"<p>not here</p>"}</script>
<script>for (var i = 0; i < links.length; i++) { document.write("<p class='ad'>x</p>"); }</script></head>
<body class="article-page"><div id="consent-banner" role="dialog"><p>We use cookies to improve your visit.</p><button>Accept</button></div>
<header class="masthead"><a href="/">The Daily</a><nav><ul><li><a href="/w">World</a></li><li><a href="/s">Sport</a></li><li><a href="/c">Culture</a></li></ul></nav></header>
<main><article class="story"><h1>Harbour reopens after two years</h1>
<p>The old harbour was opened again on Monday, two years after a storm had broken its outer wall.</p>
<p>&ldquo;It took longer than we had hoped,&rdquo; the mayor said, &ldquo;but the new wall will hold.&rdquo;</p>
<aside class="related"><h3>Related</h3><ul><li><a href="/1">Storm damage in pictures</a></li><li><a href="/2">The cost of the wall</a></li></ul></aside>
<p>Ferries leave from the eastern quay every hour until nine in the evening.</p></article></main>
<section class="comments"><h2>2 comments</h2><div class="comment"><p>About time, I say.</p></div><div class="comment"><p>What did it cost us?</p></div></section>
<footer class="site-footer"><p>&copy; The Daily. All rights reserved.</p></footer></body></html>""",
        "Harbour reopens after two years The old harbour was opened again on Monday, two years after a storm had broken its outer wall. "
        "“It took longer than we had hoped,” the mayor said, “but the new wall will hold.” Ferries leave from the eastern quay every hour until nine in the evening.",
    ),
    "blog": (
        """<html><head><title>My garden</title><style>.post > p { margin: 0 }</style></head><body>
<div id="wrapper"><div id="header"><h2><a href="/">A garden blog</a></h2></div>
<div class="menu"><a href="/">Home</a> | <a href="/about">About</a> | <a href="/archive">Archive</a></div>
<div id="content" class="post"><h1 class="entry-title">Tomatoes in a cold spring</h1><div class="entry-content"><p>This year the frost came back in the second week of May and took half of the seedlings.<p>I had kept a dozen pots in the kitchen,
and they are <em>doing well</em> &mdash; better than those of last year.<p>Next week I'll write about beans.</div>
<script>if (a<b && c>d) { track('</p><p>'); }</script></div>
<div id="sidebar"><h3>Popular posts</h3><ul><li><a href="/x">How to prune roses</a><li><a href="/y">Compost for beginners</a></ul><form action="/s"><input name=q><button>Search</button></form></div>
<div id="footer">Powered by leaves &amp; rain.</div></div></body></html>""",
        "Tomatoes in a cold spring This year the frost came back in the second week of May and took half of the seedlings. I had kept a dozen pots in the kitchen, "
        "and they are doing well — better than those of last year. Next week I'll write about beans.",
    ),
    "docs": (
        """<!DOCTYPE html><html><head><script><!-- var x = "</div>"; --></script><title>Install</title></head><body>
<nav class="toc" aria-label="Contents"><ol><li><a href="#a">Install</a></li><li><a href="#b">Configure</a></li><li><a href="#c">Run</a></li></ol></nav>
<main role="main" class="content"><h1>Install the server</h1><p>The server needs four cores and eight gigabytes of memory.</p><h2>From a package</h2>
<p>Download the package for your system, check its sum, and unpack it into a folder of your choice.</p><pre>tar xf server.tar</pre>
<ul><li>The folder must not be shared with another server.</li><li>The user that runs it must be able to write there.</li></ul><h2>Check</h2><p>Start it and open the status page; it should say that the server is ready.</p></main>
<footer><a href="/privacy">Privacy</a> <a href="/terms">Terms</a></footer></body></html>""",
        "Install the server The server needs four cores and eight gigabytes of memory. From a package Download the package for your system, check its sum, and unpack it into a folder of your choice. tar xf server.tar "
        "The folder must not be shared with another server. The user that runs it must be able to write there. Check Start it and open the status page; it should say that the server is ready.",
    ),
    "magazine": (
        """<html><body><section class="top-bar promo"><p>Subscribe now and save half!</p></section>
<div class="navbar"><ul class="menu"><li><a href=/a>Essays</a></li><li><a href=/b>Fiction</a></li><li><a href=/c>Poems</a></li></ul></div>
<div class="article-body"><h1>The lighthouse keeper's last winter</h1><blockquote>He counted the ships that didn't come.</blockquote>
<p>There is a room at the top of the tower in which nobody has slept since the lamp was made to light itself.</p>
<div class="ad-slot"><p>Buy our lamp oil, the best in town!</p></div>
<p>The keeper's daughter still climbs the stairs on Sundays. She dusts the lens, she winds the clock, and she writes one line into the book.</p>
<p>On the last page there is a drawing of a gull.</p></div>
<div class="share"><a href=#>Share</a> <a href=#>Post</a></div>
<div class="newsletter"><h3>Our newsletter</h3><p>Enter your address to get our best essays each week.</p><form><input type=email></form></div>
<div class="legal copyright">Copyright 2024, all rights reserved.</div></body></html>""",
        "The lighthouse keeper's last winter He counted the ships that didn't come. There is a room at the top of the tower in which nobody has slept since the lamp was made to light itself. "
        "The keeper's daughter still climbs the stairs on Sundays. She dusts the lens, she winds the clock, and she writes one line into the book. On the last page there is a drawing of a gull.",
    ),
    "forum": (
        """<html><head><script src="x.js"></script><script>var s='<!--';</script></head><body><header><h2>Cooks' corner</h2><nav><a href="/">Home</a><a href="/new">New</a></nav></header>
<article><h1>How I make rye bread</h1><p>Mix the flour, the water and a spoon of the starter in the evening, and let it stand in a warm place.</p>
<p>In the morning the dough should have doubled. Add the salt, shape a loaf, and wait for another hour.</p><table><tr><td>Rye flour</td><td>500 g</td></tr><tr><td>Water</td><td>400 g</td></tr></table>
<p>Bake it hot for ten minutes and then at a lower heat for fifty.</p></article>
<section class="replies discussion"><h3>Replies</h3><div class="reply"><p>I tried it, and it was far too sour.</p></div><div class="reply"><p>Mine came out well, thank you!</p></div></section>
<div class="cookie-notice">This site uses cookies. <a href="/c">More</a></div></body></html>""",
        "How I make rye bread Mix the flour, the water and a spoon of the starter in the evening, and let it stand in a warm place. In the morning the dough should have doubled. Add the salt, shape a loaf, and wait for another hour. "
        "Rye flour 500 g Water 400 g Bake it hot for ten minutes and then at a lower heat for fifty.",
    ),
    "table": (
        """<html><head><title>Lighthouses</title></head><body bgcolor=white><table width=90%><tr><td colspan=2><img src=logo.gif> The lighthouse page</td></tr>
<tr><td><a href=a.html>Home</a><br><a href=b.html>Towers of the north</a><br><a href=c.html>Lenses</a><br><a href=d.html>Guest book</a></td>
<td><p>The tower on the point was built of grey stone, and its lamp could be seen from eighteen miles away.</p><p>In the first years three families lived beside it. They kept goats, and they grew what the wind left them.</p>
<p>When the lamp was changed for an electric one the keepers moved to the village, and the houses fell in.</p></td></tr><tr><td colspan=2>Copyright 1999 by the friends of the tower</td></tr></table></body></html>""",
        "The tower on the point was built of grey stone, and its lamp could be seen from eighteen miles away. In the first years three families lived beside it. They kept goats, and they grew what the wind left them. "
        "When the lamp was changed for an electric one the keepers moved to the village, and the houses fell in.",
    ),
    "table of three columns": (
        """<html><body><table><tr><td>River walks</td></tr><tr><td><a href=1>Maps</a> | <a href=2>Tours</a> | <a href=3>Prices</a> | <a href=4>Contact</a></td></tr></table>
<table><tr><td><a href=5>Upper valley</a><br><a href=6>Lower valley</a><br><a href=7>The mills</a></td><td><h1>From the spring to the mill</h1>
<p>The path begins behind the church and follows the water for two hours, mostly in the shade.</p><p>After the second bridge it climbs to a meadow; from there one sees the whole valley, the mill and the ponds.</p>
<p>Take good shoes, because the last part is wet in every season.</p></td></tr></table><table><tr><td>&copy; 2001 River walks, all rights reserved</td></tr></table></body></html>""",
        "From the spring to the mill The path begins behind the church and follows the water for two hours, mostly in the shade. After the second bridge it climbs to a meadow; from there one sees the whole valley, the mill and the ponds. "
        "Take good shoes, because the last part is wet in every season.",
    ),
    "manual": (
        """<!doctype html><html><head><title>Backups</title></head><body><div class="sidebar"><ul><li><a href="/i">Installing</a></li><li><a href="/b">Backups</a></li><li><a href="/r">Restoring</a></li><li><a href="/u">Upgrading</a></li></ul></div>
<section class="doc"><h1>Making a backup</h1><p>A backup holds all tables and the settings, but not the logs.</p><pre>store backup --to /var/backups</pre>
<p>The command returns once the copy has been checked. It can be run while the server is in use.</p><ol><li>Choose a folder with enough room.</li><li>Run the command once a day.</li></ol></section>
<form class="feedback"><p>Was this page helpful?</p><button>Yes</button><button>No</button></form></body></html>""",
        "Making a backup A backup holds all tables and the settings, but not the logs. store backup --to /var/backups The command returns once the copy has been checked. It can be run while the server is in use. "
        "Choose a folder with enough room. Run the command once a day.",
    ),
    "manual with pager": (
        """<html><body><header><a href="/">Loom</a> <a href="/docs">Docs</a></header><nav class="docs-nav"><ul><li><a href="/1">Threads</a></li><li><a href="/2">Patterns</a></li><li><a href="/3">Exports</a></li></ul></nav>
<div class="markdown-body"><h1>Patterns</h1><p>A pattern says for each thread of the warp when it is lifted.</p><h2>A first pattern</h2><p>Write one line for each row. A cross lifts the thread, a dot leaves it down.</p><pre><code>x.x. .x.x</code></pre>
<p>Repeat the two rows until the cloth is long enough.</p></div><div class="pager"><a href="/1">Threads</a> <a href="/3">Exports</a></div><footer>Loom is free software.</footer></body></html>""",
        "Patterns A pattern says for each thread of the warp when it is lifted. A first pattern Write one line for each row. A cross lifts the thread, a dot leaves it down. x.x. .x.x Repeat the two rows until the cloth is long enough.",
    ),
}
