"""Crawlers by list order (specific before general), their companies, and asset names.

Results must equal the registry's, so keys, labels, categories and name
suffixes stand here as they are.
"""

from __future__ import annotations

#: Key, label, category, suffixes of its host names.
BOTS = [
    ("google-inspectiontool", "Google-InspectionTool", "search", [".googlebot.com", ".google.com"]),
    ("googlebot-image", "Googlebot-Image", "search", [".googlebot.com", ".google.com"]),
    ("googlebot-video", "Googlebot-Video", "search", [".googlebot.com", ".google.com"]),
    ("googlebot-news", "Googlebot-News", "search", [".googlebot.com", ".google.com"]),
    ("storebot-google", "Storebot-Google", "search", [".googlebot.com", ".google.com"]),
    ("googleother", "GoogleOther", "search", [".googlebot.com", ".google.com"]),
    ("google-extended", "Google-Extended", "ai_training", [".googlebot.com", ".google.com"]),
    ("adsbot-google", "AdsBot-Google", "seo_tool", [".googlebot.com", ".google.com"]),
    ("apis-google", "APIs-Google", "seo_tool", [".googlebot.com", ".google.com"]),
    ("feedfetcher-google", "Feedfetcher-Google", "seo_tool", [".google.com"]),
    ("googlebot", "Googlebot", "search", [".googlebot.com", ".google.com"]),
    ("bingbot", "bingbot", "search", [".search.msn.com"]),
    ("adidxbot", "adidxbot", "seo_tool", [".search.msn.com"]),
    ("msnbot", "msnbot", "search", [".search.msn.com"]),
    ("bingpreview", "BingPreview", "search", [".search.msn.com"]),
    ("chatgpt-user", "ChatGPT-User", "ai_user", []),
    ("oai-searchbot", "OAI-SearchBot", "ai_search", []),
    ("gptbot", "GPTBot", "ai_training", []),
    ("claude-user", "Claude-User", "ai_user", []),
    ("claude-searchbot", "Claude-SearchBot", "ai_search", []),
    ("claudebot", "ClaudeBot", "ai_training", []),
    ("anthropic-ai", "anthropic-ai", "ai_training", []),
    ("perplexity-user", "Perplexity-User", "ai_user", []),
    ("perplexitybot", "PerplexityBot", "ai_search", []),
    ("applebot-extended", "Applebot-Extended", "ai_training", [".applebot.apple.com"]),
    ("applebot", "Applebot", "search", [".applebot.apple.com"]),
    ("amazonbot", "Amazonbot", "ai_training", [".crawl.amazon.com"]),
    ("meta-externalagent", "meta-externalagent", "ai_training", []),
    ("meta-externalfetcher", "meta-externalfetcher", "ai_user", []),
    ("facebookexternalhit", "facebookexternalhit", "social", []),
    ("twitterbot", "Twitterbot", "social", []),
    ("linkedinbot", "LinkedInBot", "social", []),
    ("slackbot", "Slackbot", "social", []),
    ("discordbot", "Discordbot", "social", []),
    ("telegrambot", "TelegramBot", "social", []),
    ("whatsapp", "WhatsApp", "social", []),
    ("yandexbot", "YandexBot", "search", [".yandex.ru", ".yandex.net", ".yandex.com"]),
    ("duckassistbot", "DuckAssistBot", "ai_search", []),
    ("duckduckbot", "DuckDuckBot", "search", []),
    ("baiduspider", "Baiduspider", "search", [".baidu.com", ".baidu.jp"]),
    ("seznambot", "SeznamBot", "search", [".seznam.cz"]),
    ("petalbot", "PetalBot", "search", [".petalsearch.com", ".aspiegel.com"]),
    ("mojeekbot", "MojeekBot", "search", []),
    ("qwantbot", "Qwantbot", "search", []),
    ("ccbot", "CCBot", "ai_training", []),
    ("bytespider", "Bytespider", "ai_training", []),
    ("youbot", "YouBot", "ai_search", []),
    ("cohere-ai", "cohere-ai", "ai_training", []),
    ("diffbot", "Diffbot", "ai_training", []),
    ("imagesiftbot", "ImagesiftBot", "ai_training", []),
    ("timpibot", "Timpibot", "ai_training", []),
    ("omgilibot", "Omgilibot", "ai_training", []),
    ("mistralai-user", "MistralAI-User", "ai_user", []),
    ("ahrefsbot", "AhrefsBot", "seo_tool", [".ahrefs.com", ".ahrefs.net"]),
    ("semrushbot", "SemrushBot", "seo_tool", [".semrush.com"]),
    ("dataforseobot", "DataForSeoBot", "seo_tool", [".dataforseo.com"]),
    ("mj12bot", "MJ12bot", "seo_tool", []),
    ("dotbot", "DotBot", "seo_tool", [".opensiteexplorer.org", ".moz.com"]),
    ("rogerbot", "rogerbot", "seo_tool", [".moz.com"]),
    ("blexbot", "BLEXBot", "seo_tool", [".webmeup.com"]),
    ("barkrowler", "Barkrowler", "seo_tool", [".babbar.tech"]),
    ("serpstatbot", "serpstatbot", "seo_tool", []),
    ("screaming frog", "ScreamingFrog", "seo_tool", []),
    ("sitebulb", "Sitebulb", "seo_tool", []),
    ("zoominfobot", "ZoominfoBot", "seo_tool", []),
    ("censysinspect", "CensysInspect", "seo_tool", []),
    ("internetmeasurement", "InternetMeasurement", "seo_tool", []),
]
CATEGORIES = ("search", "ai_search", "ai_user", "ai_training", "social", "seo_tool")

#: Companies by fragments of keys, in list order.
OPERATORS = [
    ("oai-searchbot", "OpenAI"),
    ("chatgpt-user", "OpenAI"),
    ("gptbot", "OpenAI"),
    ("claude-searchbot", "Anthropic"),
    ("claude-user", "Anthropic"),
    ("claudebot", "Anthropic"),
    ("anthropic-ai", "Anthropic"),
    ("perplexity-user", "Perplexity"),
    ("perplexitybot", "Perplexity"),
    ("applebot-extended", "Apple"),
    ("applebot", "Apple"),
    ("google-extended", "Google"),
    ("googlebot", "Google"),
    ("googleother", "Google"),
    ("adsbot-google", "Google"),
    ("apis-google", "Google"),
    ("feedfetcher-google", "Google"),
    ("storebot-google", "Google"),
    ("google-inspectiontool", "Google"),
    ("bingbot", "Microsoft"),
    ("bingpreview", "Microsoft"),
    ("msnbot", "Microsoft"),
    ("meta-externalagent", "Meta"),
    ("facebookexternalhit", "Meta"),
    ("amazonbot", "Amazon"),
    ("bytespider", "ByteDance"),
    ("ccbot", "CommonCrawl"),
    ("cohere-ai", "Cohere"),
    ("mistralai-user", "MistralAI"),
    ("diffbot", "Diffbot"),
    ("yandexbot", "Yandex"),
    ("baiduspider", "Baidu"),
    ("duckduckbot", "DuckDuckGo"),
    ("duckassistbot", "DuckDuckGo"),
    ("ahrefsbot", "Ahrefs"),
    ("semrushbot", "Semrush"),
    ("mj12bot", "Majestic"),
    ("dotbot", "Moz"),
    ("dataforseobot", "DataForSEO"),
    ("youbot", "You.com"),
]

#: Fixed value: names of assets.
ASSET = r"(?i)\.(?:js|mjs|css|map|png|jpe?g|gif|webp|avif|svg|ico|woff2?|ttf|eot|mp4|webm|mp3|ogg|wav|wasm|zip|gz|br|bsp|wad|spr|mdl|pak|data|bin)(?:$|\?)"
